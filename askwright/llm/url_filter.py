"""URL rules as a bit-parallel wildcard automaton (Shift-And with self-loops).

All globs are packed into one bit vector of as many 64-bit words as needed.  A literal or a class takes one bit;
a star adds a self-loop to the bit before it (``*`` stays within a host or path part, ``**`` takes anything);
``?`` is any one byte but ``/``.  Each byte of a URL costs, for all patterns at once,

    D = (((D << 1) | starts) & CAN[byte]) | (D & STAY[byte])

and a batch of URLs is simulated together, byte position by byte position, longest first, so that finished URLs
drop out.  A pattern is matched when its last bit is set after the last byte.

URLs are judged in canonical form: host with A-Z lower-cased, then the path; what precedes ``://``, the query and
the fragment are cut.  Rules and globs are simulated together in one automaton.  Defined cases: a null URL or one without ``://``
has an empty host and path, fits no rule and gets the verdict of the globs; of rules of equal length the first listed
decides; repeated rows are each judged; empty tables give no rows; very long URLs are read to the end; the columns host, path, rule and
verdict of the result take the place of columns of these names, also where one of them holds the URLs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Fixed values of the contract: verdict and rule (host, then path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Glob rules of the query, host and path: what no rule names is blocked when one of these matches.  Without a path any path fits.
BLOCK_GLOBS = (
    "*casino*",
    "*free-bets*",
    "*betting*",
    "*cheap-pills*",
    "*ads-track*",
    "*adserver*",
    "ads.*",
    "*/**.exe",
    "*/**.apk",
    "*/**.zip",
    "*/cgi-bin/**",
    "*/**wp-login**",
)
END = 0x00  # ends the host, so that no pattern for a host reaches into the path


class GlobAutomaton:
    """Masks of a list of globs; ``matches`` gives a boolean matrix, a column for each glob."""

    def __init__(self, globs: Sequence[bytes]):
        can: list[tuple[int, np.ndarray]] = []
        stay: list[tuple[int, np.ndarray]] = []
        starts, self.last = [], []
        part, any_byte = np.ones(256, bool), np.ones(256, bool)
        part[[END, ord("/")]] = False
        bit = 0
        for glob in globs:
            # bit 0 of a glob is passed by a mark put before every URL, so that a leading star has a bit to stay on
            starts.append(bit)
            can.append((bit, self._only(256)))
            i = 0
            while i < len(glob):
                if glob[i] == ord("*"):
                    wide = glob[i : i + 2] == b"**"
                    stay.append((bit, any_byte if wide else part))
                    i += 2 if wide else 1
                    continue
                bit += 1
                can.append((bit, part if glob[i] == ord("?") else self._only(glob[i])))
                i += 1
            self.last.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.can, self.stay = np.zeros((257, self.words), np.uint64), np.zeros((257, self.words), np.uint64)
        for masks, entries in ((self.can, can), (self.stay, stay)):
            for at, allowed in entries:
                masks[: len(allowed), at // 64][allowed] |= np.uint64(1 << (at % 64))
        self.start = np.zeros(self.words, np.uint64)
        for at in starts:
            self.start[at // 64] |= np.uint64(1 << (at % 64))

    @staticmethod
    def _only(byte: int) -> np.ndarray:
        allowed = np.zeros(257, bool)
        allowed[byte] = True
        return allowed

    def _step(self, d: np.ndarray, byte: np.ndarray, first: bool) -> np.ndarray:
        moved = d << np.uint64(1)
        moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
        # the shift carries the last bit of a glob into the first of the next; CAN of first bits holds the mark only
        if first:
            moved |= self.start
        return (moved & self.can[byte]) | (d & self.stay[byte])

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[order] if len(texts) else np.zeros(0, np.int64)
        left = lengths[order]
        d = self._step(np.zeros((len(texts), self.words), np.uint64), np.full(len(texts), 256), True)
        at = 0
        live = int(np.searchsorted(-left, 0, side="left"))
        while live:
            d[:live] = self._step(d[:live], data[begin[:live] + at].astype(np.int64), False)
            at += 1
            live = int(np.searchsorted(-left[:live], -at, side="left"))
        out = np.zeros((len(texts), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            out[order, k] = (d[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def rule_globs(rule: str) -> list[bytes]:
    """The globs of a rule: its host itself, and any subdomain."""
    host, slash, path = rule.partition("/")
    rest = host.encode() + bytes([END]) + (slash + path).encode() + b"**"
    return [rest, b"*." + rest]


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, block_globs: Sequence[str] = (), default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The longest rule that fits decides.  Where none fits, a URL that one of ``block_globs`` (on host and path) matches is
    blocked, any other gets ``default``.
    """
    globs, owner = [], []
    for i, (_, rule) in enumerate(rules):
        for glob in rule_globs(rule):
            globs.append(glob)
            owner.append(i)
    for glob in block_globs:
        host, slash, path = glob.partition("/")
        globs.append(host.encode() + bytes([END]) + ((slash + path).encode() if slash else b"**"))
        owner.append(-1)
    owner_of, verdicts, names = np.array(owner), [v for v, _ in rules], [r for _, r in rules]
    length = np.array([len(r) for r in names])
    automaton = GlobAutomaton(globs)

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in parts:
            hit = automaton.matches([h.encode().replace(b"\0", b"\x01") + bytes([END]) + p.encode() for h, p in zip(host, path, strict=True)])
            best = np.full(len(host), -1)
            most = np.full(len(host), -1)
            for k, i in enumerate(owner_of):
                better = hit[:, k] & (i >= 0) & (length[i] > most)
                best[better], most[better] = i, length[i]
            blocked = hit[:, owner_of == -1].any(axis=1)
            yield pd.DataFrame({"rule": [names[i] if i >= 0 else None for i in best], "verdict": [verdicts[i] if i >= 0 else "block" if b else default for i, b in zip(best, blocked, strict=True)]})

    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(pages[url_col], F.lit(""))
    made = ("host", "path", "rule", "verdict")
    others = [pages[c] for c in pages.columns if c.lower() not in made]
    host, path = ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)
    parts = pages.select(*others, host.alias("host"), path.alias("path"))
    return parts.withColumn("__aw", judge("host", "path")).select(*[c.name for c in parts.schema], "__aw.rule", "__aw.verdict")


def op5_url_rules(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), block_globs=BLOCK_GLOBS).drop("url")


_FITS = " ".join(f"WHEN starts_with(path, '/{r.partition('/')[2]}') AND (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) THEN '{r}'" for _, r in sorted(RULES, key=lambda x: -len(x[1])))
#: The globs as SQL patterns; none of them holds a question mark, and hosts hold no slash.
_LIKE = " OR ".join(f"(host LIKE '{h.replace('*', '%')}'" + (f" AND path LIKE '/{p.replace('**', '%').replace('*', '%')}')" if slash else ")") for h, slash, p in (g.partition("/") for g in BLOCK_GLOBS))
_BLOCKED = ", ".join(f"'{r}'" for v, r in RULES if v == "block")
ORACLE = {
    "op5_url_rules": f"""
SELECT page_id, host, path, rule, CASE WHEN rule IN ({_BLOCKED}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN {_LIKE} THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, CASE {_FITS} END AS rule
      FROM (SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages))"""
}
QUERIES = {"op5_url_rules": op5_url_rules}
