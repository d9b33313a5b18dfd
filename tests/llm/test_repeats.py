"""Steps of the suffix sort in this process: what is sorted, and repeats where hashes collide."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from askwright.llm import suffix_dedup as S

from .test_text_operators import brute_repeats, repeat_rows


def steps(rows, bits=2, chunks=3):
    """What op6 makes of (id, text) without copies and nulls, and the bytes of the runs that are sent."""
    docs = pd.DataFrame([(i, i, 0, t.encode()) for i, t in rows], columns=["doc_id", "ord", "mark", "text"])
    sent = S._send_anchors(bits)(iter([pa.RecordBatch.from_pandas(docs[["ord", "text"]], preserve_index=False)]))
    blobs = pd.concat([b.to_pandas() for b in sent])
    told = pd.concat([S._repeated_anchors(chunks, 1 << 16)(g) for _, g in blobs.groupby("bucket")])
    at = lambda df, c: df[df["chunk"] == c].assign(ord=None)
    runs = pd.concat([S._send_runs(bits)((c,), docs[docs["ord"] % chunks == c], at(told, c)) for c in range(chunks)])
    answers = pd.concat([S._sort_bucket(g) for _, g in runs.groupby("bucket")])
    told = pd.concat([told, answers])
    cut = pd.concat([S._cut(bits)((c,), docs[docs["ord"] % chunks == c], at(told, c)) for c in range(chunks)])
    return sorted(map(tuple, cut.itertuples(index=False)), key=repr)


def whole_rows():
    rows = {i: t for i, t in repeat_rows() if i is not None and t}
    return [(i, t) for t, i in {t: i for i, t in rows.items()}.items()]


def test_a_passage_of_many_documents_is_sorted_once(monkeypatch):
    """The suffixes that are sorted grow with different passages, not with how often each occurs."""
    rng, sorted_ = np.random.default_rng(9), []
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(80)
    plain = S.suffix_classes
    monkeypatch.setattr(S, "suffix_classes", lambda data, start, *a: sorted_.append(len(start)) or plain(data, start, *a))
    told = {}
    for n in (40, 160):
        sorted_.clear()
        rows = [(i, word(60) + passage + word(60)) for i in range(n)]
        assert steps(rows) == brute_repeats(rows)
        told[n] = sum(sorted_)
    assert told[160] < 5 * (len(passage) - S.SPAN + 1)  # of 160 times as many


@pytest.mark.parametrize("keep", [0x0, 0x7, 0xFFFF])
def test_colliding_contents_and_windows(monkeypatch, keep):
    """Hashes of runs and windows with few bits: the bytes decide."""
    rows = whole_rows()
    plain = S.PrefixHashes.of
    monkeypatch.setattr(S.PrefixHashes, "of", lambda self, start, length: plain(self, start, length) & np.uint64(keep))
    assert steps(rows) == brute_repeats(rows)
