"""Find the 64-bit tokens that occur more than once over all rows, and tell each owner which of its tokens those are.

A token per row would cost tens of bytes for each; here tokens travel in packed binary columns, one row for each task
chunk and bucket, and a bucket is answered with one sort. Buckets follow the tokens' number, so that each holds about
``TOKENS_PER_BUCKET``. A token that half of all rows hold is met in its chunk already: two of its entries go to the
bucket, where other chunks' entries must be told of it; the rest of the chunk's are known to be shared and go, in one row, to
one of ``SPREAD`` places where nothing has to meet. No bucket grows with a hot token by more than two entries a chunk.
Answers go back in the same form, one row for each bucket and range of owners, and become one row for each owner there.
Tokens are compared in all their 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldbook.llm import bytescan

U = np.uint64
TOKENS_PER_BUCKET = 2_500_000
SPREAD = 1 << 20
POSTED = "bucket int, owners binary, counts binary, tokens binary, marks binary"
ANSWERED = "range int, owners binary, counts binary, items binary"


def buckets(tokens: int) -> int:
    return max(1, min(-(-tokens // TOKENS_PER_BUCKET), 1 << 24))


def post(owner: np.ndarray, token: np.ndarray, mark: np.ndarray | None, parts: int) -> pa.RecordBatch:
    """The rows that one chunk sends. Entries are distinct; ``mark`` (32 bits) is returned instead of the token."""
    bucket = ((token >> U(40)) % U(parts)).astype(np.int64)
    by = np.argsort(token, kind="stable")
    new = np.ones(len(by), dtype=bool)
    new[1:] = token[by[1:]] != token[by[:-1]]
    at = np.flatnonzero(new)
    rank = np.arange(len(by)) - at[np.cumsum(new) - 1]
    bucket[by[rank >= 2]] = parts + int(bytescan.mix(owner[:1])[0] % U(SPREAD)) if len(owner) else 0
    by = np.lexsort((owner, bucket))
    bucket, owner, token = bucket[by], owner[by], token[by]
    mark = None if mark is None else mark[by].astype(np.uint32)
    new = np.ones(len(by), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    rows = np.flatnonzero(new)
    new[1:] |= owner[1:] != owner[:-1]
    runs = np.flatnonzero(new)
    counts = np.diff(np.append(runs, len(by))).astype(np.uint32)
    row_of_run = np.searchsorted(runs, rows)
    run_ends, row_ends = np.append(row_of_run[1:], len(runs)), np.append(rows[1:], len(by))
    packed = token.astype("<u8")
    owners = owner[runs]
    cols = [bucket[rows].astype(np.int32), [], [], [], []]
    for a, b, lo, hi in zip(row_of_run, run_ends, rows, row_ends):
        cols[1].append(owners[a:b].tobytes())
        cols[2].append(counts[a:b].tobytes())
        cols[3].append(packed[lo:hi].tobytes())
        cols[4].append(b"" if mark is None else mark[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                      names=["bucket", "owners", "counts", "tokens", "marks"])


def _joined(col: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), dtype=kind)


def answers(posted: DataFrame, parts: int) -> DataFrame:
    """(owner, items): one row for each owner that has any, with the packed marks (32 bits) or tokens (64 bits) that some
    other entry has too. A token may come twice."""

    def answer(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        owner = np.repeat(_joined(group.column("owners"), "<u8"), _joined(group.column("counts"), "<u4"))
        token = _joined(group.column("tokens"), "<u8")
        mark = _joined(group.column("marks"), "<u4")
        marked = len(mark) > 0
        by = np.lexsort((mark, owner, token) if marked else (owner, token))
        owner, token = owner[by], token[by]
        mark = mark[by] if marked else token
        new = np.ones(len(by), dtype=bool)  # copies of a text post the same entries from several chunks
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]) | (mark[1:] != mark[:-1])
        owner, token, mark = owner[new], token[new], mark[new]
        if bucket < parts:
            same = token[1:] == token[:-1]
            shared = np.zeros(len(token), dtype=bool)
            shared[1:] |= same
            shared[:-1] |= same
            owner, mark = owner[shared], mark[shared]
        return _by_range(owner, mark)

    def _by_range(owner: np.ndarray, item: np.ndarray) -> pa.Table:
        part = ((owner >> U(40)) % U(parts)).astype(np.int32)
        by = np.lexsort((owner, part))
        part, owner, item = part[by], owner[by], item[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = part[1:] != part[:-1]
        rows = np.flatnonzero(new)
        new[1:] |= owner[1:] != owner[:-1]
        runs = np.flatnonzero(new)
        counts = np.diff(np.append(runs, len(by))).astype("<u4")
        first = np.searchsorted(runs, rows)
        out = [part[rows], [], [], []]
        for a, b, lo, hi in zip(first, np.append(first[1:], len(runs)), rows, np.append(rows[1:], len(by))):
            out[1].append(owner[runs[a:b]].tobytes())
            out[2].append(counts[a:b].tobytes())
            out[3].append(item[lo:hi].tobytes())
        return pa.table({"range": pa.array(out[0], pa.int32()), "owners": pa.array(out[1], pa.binary()),
                         "counts": pa.array(out[2], pa.binary()), "items": pa.array(out[3], pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        owner = np.repeat(_joined(group.column("owners"), "<u8"), _joined(group.column("counts"), "<u4"))
        raw = _joined(group.column("items"), np.uint8)
        item = raw.view("<u8" if len(raw) == 8 * len(owner) else "<u4")
        by = np.argsort(owner, kind="stable")
        owner, item = owner[by], item[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = owner[1:] != owner[:-1]
        at = np.flatnonzero(new)
        return pa.table({"owner": pa.array(owner[at].view(np.int64), pa.int64()),
                         "items": pa.array([item[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(by)))], pa.binary())})

    told = posted.groupBy("bucket").applyInArrow(answer, ANSWERED)
    return told.groupBy("range").applyInArrow(gather, "owner long, items binary")
