"""The difference hash works its grey values out once for a picture."""

from pyspark.sql import functions as F

from askwright.operators import assembly as A


def test_grey_values_once(spark):
    df = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.lit(271)), lambda k: k * 7919 % 256 + F.col("id") * k % 3).alias("g"))
    told = df.select("g", A.difference_hash(F.transform("g", lambda x: x + 4242)).alias("digest"))
    assert told.select("digest")._jdf.queryExecution().analyzed().toString().split("\n")[1].count("4242") == 1
    for g, digest in told.collect():
        bits = "".join(str(int(g[r * 17 + c + 1] > g[r * 17 + c])) for r in range(16) for c in range(16))
        assert digest == f"{int(bits, 2):064x}"
