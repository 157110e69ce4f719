"""Removal of repeated byte strings over a whole corpus, decided by run-length Burrows-Wheeler indexes.

A byte is removed if a string of ``size`` bytes that covers it also starts earlier (smaller document id, or
the same document and a smaller start).  The corpus is cut so that equal strings always meet:

1. The smallest hash among a window's ``GRAM``-byte substrings (its anchor) depends on its content alone, so
   equal windows have equal anchors, whatever else collides.  Neighbouring windows with one anchor form a segment.  A
   segment whose whole content occurred before is a repeat; only the first one of each content and slice of the input
   is sent on, so copies are pre-aggregated before any shuffle.
2. Buckets of anchors keep the first segment of each content.  An anchor with one content is settled.
3. The contents of the other anchors meet, in order of first occurrence, in a run-length index of bounded
   size; streaming its matching statistics marks each window that starts earlier as well.
4. Anchors with very many different contents (a passage that a large part of all documents shares, at its
   ends) are estimated beforehand from the contents whose hash falls into a fixed share, the same for every anchor, and
   their segments sent as single windows keyed by the window's own hash.  An anchor that still comes to a bucket
   with more than ``MANY`` contents gives up its windows there: a grouped minimum finds each one's first place.  So no
   index holds more than ``MANY`` segments, whatever the corpus holds.

Contents are told apart by 128 bits of XXH3, all else is exact.  Null and empty texts have no window; rows with a
null id are returned whole and take no part; ids are taken as unique, repeated rows count as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U64, buffers, chunks, mix, prefix, substring
from .common import parts, saved, tidy, whole
from .rlindex import RunIndex

GRAM, MOST, SLICE, INDEX_SYMBOLS = 32, 255, 16 << 20, 1 << 18
#: Contents of an anchor beyond which it is split: in a bucket, and beforehand (at least; then at most HOT anchors are).
MANY, SPLIT, HOT, SHARE = 4096, 512, 1 << 20, 64


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = f(x[:-done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def digests(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of data[s:e], as two numbers each."""
    raw = data.tobytes()
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]), U64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def segments(data: np.ndarray, off: np.ndarray, size: int, hot: np.ndarray, contents: bool = True) -> dict[str, np.ndarray] | None:
    """Segments of the documents: anchor a, content (c, c2), document index d, start, windows nw, and own repeats.

    Without ``contents``, c is a cheaper hash and c2 is left out.
    """
    n, span = len(data), size - GRAM + 1
    if n < size:
        return None
    h = prefix(data)
    i = np.arange(n - GRAM + 1)
    g = substring(h, i, i + GRAM)
    m = _slide(g, span, np.minimum)
    valid = np.ones(len(m), dtype=bool)
    for e in off[1:-1]:
        valid[max(0, e - size + 1) : e] = False
    # Positions that are some window's anchor; a value twice in a row means windows can repeat within a segment.  Across a gap of span, the windows are still neighbours.
    if not valid.any():
        return None
    wide = np.concatenate([np.zeros(span - 1, U64), np.where(valid, m, U64(0)), np.zeros(span - 1, U64)])
    spots = np.flatnonzero(_slide(wide, span, np.maximum) == g)
    v = g[spots]
    own = np.unique(v[:-1][(v[1:] == v[:-1]) & (np.diff(spots) <= span)])
    change = m[1:] != m[:-1]
    first = valid.copy()
    first[1:] &= change | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= change | ~valid[1:]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if (e - s).max(initial=0) > MOST:
        k = (e - s + MOST - 1) // MOST
        nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        s, e = np.repeat(s, k) + nth * MOST, np.minimum(np.repeat(s, k) + (nth + 1) * MOST, np.repeat(e, k))
    a = m[s]
    own = np.isin(a, own) if len(own) else np.zeros(len(a), bool)
    if not contents:
        return {"a": a, "c": substring(h, s, e + size - 1)}
    key = a
    if len(hot) and (is_hot := np.isin(a, hot)).any():
        hs, hw = s[is_hot], (e - s)[is_hot]
        w = np.repeat(hs, hw) + np.arange(hw.sum()) - np.repeat(np.cumsum(hw) - hw, hw)
        s, e = np.concatenate([s[~is_hot], w]), np.concatenate([e[~is_hot], w + 1])
        key, own = np.concatenate([a[~is_hot], np.zeros(len(w), U64)]), np.concatenate([own[~is_hot], np.zeros(len(w), bool)])
        c, c2 = digests(data, s, e + size - 1)
        key[len(key) - len(w) :] = mix(c[len(key) - len(w) :] + U64(77))  # windows are keyed by their own hash
    else:
        c, c2 = digests(data, s, e + size - 1)
    d = np.searchsorted(off, s, side="right") - 1
    return {"a": key, "c": c, "c2": c2, "d": d, "s": (s - off[d]).astype(np.uint32), "nw": (e - s).astype(np.uint8), "own": own}


def _slices(batches, size: int, hot: np.ndarray, contents: bool = True):
    """All segments of a partition with document ids in d, in slices of about ``SLICE`` bytes of text."""
    got: list[dict] = []
    held = 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, off = buffers(batch.column(1))
        for a, b in chunks(off, 1 << 19):
            o = off[a : b + 1]
            if x := segments(data[o[0] : o[-1]], o - o[0], size, hot, contents):
                if contents:
                    x["d"] = ids[a + x["d"]]
                got.append(x)
            held += int(o[-1] - o[0])
            if held >= SLICE and got:
                yield {k: np.concatenate([x[k] for x in got]) for k in got[0]}
                got, held = [], 0
    if got:
        yield {k: np.concatenate([x[k] for x in got]) for k in got[0]}


def _firsts(x: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (anchor, content, document, start); where a new content begins; what repeats an earlier one."""
    order = np.lexsort((x["s"], x["d"], x["c2"], x["c"], x["a"]))
    a, c, c2, d, s = (x[k][order] for k in ("a", "c", "c2", "d", "s"))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = (d != d[lead]) | (s != s[lead])  # the same row given twice is not earlier
    return order, new, again


def _by_document(d: np.ndarray, s: np.ndarray, nw: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """One blob of (start << 16 | windows) for each document."""
    if not len(d):
        return d, []
    order = np.lexsort((s, d))
    d, packed = d[order], ((s.astype(np.int64) << 16) | nw)[order]
    cut = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    end = np.append(cut[1:], len(d))
    return d[cut], [packed[p:q].tobytes() for p, q in zip(cut, end, strict=True)]


_ROW = "kind int, key long, d binary, s binary, nw binary, a binary, c binary, own binary"


def _row(kind, key, **cols):
    return {"kind": kind, "key": key} | {k: cols.get(k) for k in ("d", "s", "nw", "a", "c", "own")}


def _emit(rows: list[dict]):
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        arrays = [pa.array([r["kind"] for r in part], pa.int32()), pa.array([r["key"] for r in part], pa.int64())]
        arrays += [pa.array([r[c] for r in part], pa.binary()) for c in ("d", "s", "nw", "a", "c", "own")]
        yield pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "d", "s", "nw", "a", "c", "own"])


def _marks(d, s, nw):
    ids, blobs = _by_document(d, s, nw)
    return [_row(1, int(i), s=b) for i, b in zip(ids, blobs, strict=True)]


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, marks): runs of window starts that also occur earlier, packed, in any number of rows a document."""
    docs = docs.where("doc_id is not null")
    n = parts(docs, "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 4 * n

    def sampled(batches):
        for x in _slices(batches, size, np.zeros(0, U64), contents=False):
            few = x["c"] % U64(SHARE) == 0
            a, c = x["a"][few], x["c"][few]
            one = np.unique(mix(a ^ (c * U64(0x9E3779B97F4A7C15))), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(a[one].view(np.int64)), pa.array(c[one].view(np.int64))], names=["a", "c"])

    # There is an anchor for about every 27 bytes, so at most HOT anchors (8 MB) can have that many contents.
    bound = max(SPLIT, int(total) // (27 * HOT))
    found = docs.mapInArrow(tidy(sampled), "a long, c long").distinct().groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= bound / SHARE).select("a").toArrow()
    hot_anchors = docs.sparkSession.sparkContext.broadcast(np.sort(found.column("a").to_numpy()).view(U64))

    def send(batches):
        for x in _slices(batches, size, hot_anchors.value):
            order, new, again = _firsts(x)
            y = {k: v[order] for k, v in x.items()}
            out = _marks(y["d"][again], y["s"][again], y["nw"][again])
            y = {k: v[new] for k, v in y.items()}
            bucket = (y["a"] % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            y = {k: v[order] for k, v in y.items()}
            c = np.stack([y["c"], y["c2"]], axis=1)
            for b in np.flatnonzero(np.diff(edge)):
                w = slice(edge[b], edge[b + 1])
                cols = {"d": y["d"][w].astype(np.int64), "s": y["s"][w], "nw": y["nw"][w], "a": y["a"][w], "c": c[w], "own": np.packbits(y["own"][w])}
                out.append(_row(0, int(b), **{k: v.tobytes() for k, v in cols.items()}))
            yield from _emit(out)

    def settle(batches):
        parts_, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    out.append(_row(1, r["key"], s=r["s"]))
                    continue
                a, c = np.frombuffer(r["a"], U64), np.frombuffer(r["c"], U64).reshape(-1, 2)
                parts_.append({"a": a, "c": c[:, 0], "c2": c[:, 1], "d": np.frombuffer(r["d"], np.int64), "s": np.frombuffer(r["s"], np.uint32), "nw": np.frombuffer(r["nw"], np.uint8), "own": np.unpackbits(np.frombuffer(r["own"], np.uint8))[: len(a)].astype(bool)})
            if len(out) > 1024:
                yield from _emit(out)
                out = []
        if parts_:
            x = {k: np.concatenate([p[k] for p in parts_]) for k in parts_[0]}
            order, new, again = _firsts(x)
            y = {k: v[order] for k, v in x.items()}
            out += _marks(y["d"][again], y["s"][again], y["nw"][again])
            y = {k: v[new] for k, v in y.items()}
            head = np.concatenate([[True], y["a"][1:] != y["a"][:-1]])
            group = np.cumsum(head) - 1
            contents = np.bincount(group)[group]
            y["kind"] = np.where(contents > MANY, 3, 2)
            open_ = (contents > 1) | (np.bincount(group, weights=y["own"])[group] > 0)
            y = {k: v[open_] for k, v in y.items()}
            order = np.lexsort((y["d"], y["kind"]))
            y = {k: v[order] for k, v in y.items()}
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(y["d"]) != 0) | (np.diff(y["kind"]) != 0)])) if len(y["d"]) else []
            for p, q in zip(cut, np.append(cut[1:], len(y["d"])) if len(cut) else [], strict=True):
                out.append(_row(int(y["kind"][p]), int(y["d"][p]), s=y["s"][p:q].tobytes(), nw=y["nw"][p:q].tobytes(), a=y["a"][p:q].tobytes()))
        yield from _emit(out)

    sent = docs.mapInArrow(tidy(send), _ROW).repartition(n, "kind", "key")
    settled = saved(sent.mapInArrow(tidy(settle), _ROW))

    def asked(kind: int) -> DataFrame:
        own = settled.where(F.col("kind") == kind).groupBy(F.col("key").alias("doc_id"))
        return docs.join(own.agg(F.collect_list(F.struct("s", "nw", "a")).alias("ask")), "doc_id").select("doc_id", "text", "ask")  # bounded by the document

    def cut_out(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            out = {k: [] for k in ("a", "d", "s", "nw", "seg")}
            for k, (i, ask) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = data[off[k] : off[k + 1]].tobytes()
                for r in ask:
                    for s, w, a in zip(np.frombuffer(r["s"], np.uint32).tolist(), np.frombuffer(r["nw"], np.uint8).tolist(), np.frombuffer(r["a"], np.int64).tolist(), strict=True):
                        for key, v in zip(out, (a, i, s, w, text[s : s + w + size - 1]), strict=True):
                            out[key].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["d"], pa.int64()), pa.array(out["s"], pa.int64()), pa.array(out["nw"], pa.int32()), pa.array(out["seg"], pa.binary())], names=list(out))

    pieces = asked(2).mapInArrow(tidy(cut_out), "a long, d long, s long, nw int, seg binary").repartition(n, "a")

    def mark(batches):
        got = whole(batches)
        if got is None:
            return
        a, d, s, nw = (got.column(k).to_numpy() for k in ("a", "d", "s", "nw"))
        order = np.lexsort((s, d, a))
        same = np.concatenate([[False], (np.diff(d[order]) == 0) & (np.diff(s[order]) == 0) & (np.diff(a[order]) == 0)])
        order = order[~same]
        head = np.concatenate([[True], np.diff(a[order]) != 0])
        room = np.cumsum(nw[order] + size)
        starts = np.flatnonzero(head)
        out, p = [], 0
        while p < len(order):  # whole anchors, up to a number of symbols
            k = np.searchsorted(starts, np.searchsorted(room, (room[p - 1] if p else 0) + INDEX_SYMBOLS), side="right") - 1
            q = int(starts[k]) if k >= 0 and starts[k] > p else int(starts[np.searchsorted(starts, p, side="right")]) if starts[-1] > p else len(order)
            if room[-1] - (room[p - 1] if p else 0) <= INDEX_SYMBOLS:
                q = len(order)
            pick = order[p:q]
            pick = pick[np.lexsort((s[pick], d[pick]))]
            data, off = buffers(got.column("seg").take(pa.array(pick)))
            base = off[:-1] + np.arange(len(pick))
            at = RunIndex(data, off).repeats(size)
            t = np.searchsorted(base, at, side="right") - 1
            w = at - base[t]
            cut = np.concatenate([[True], (np.diff(t) != 0) | (np.diff(w) != 1)]) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(cut)
            length = np.diff(np.append(first, len(at)))
            out += _marks(d[pick[t[first]]], s[pick[t[first]]] + w[first], length)
            p = q
        yield from _emit(out)

    marked = pieces.mapInArrow(tidy(mark), _ROW)
    both = settled.where("kind = 1").select("key", "s").unionByName(marked.select("key", "s"))
    if not settled.where("kind = 3").isEmpty():
        both = both.unionByName(_first_places(asked(3), size))
    return both.select(F.col("key").alias("doc_id"), F.col("s").alias("marks"))


def _first_places(asked: DataFrame, size: int) -> DataFrame:
    """(key, s): marks of the windows of the segments asked for that have the same content as an earlier one."""

    def windows(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            for k, (i, ask) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                text = data[off[k] : off[k + 1]]
                for r in ask:
                    s, nw = np.frombuffer(r["s"], np.uint32).astype(np.int64), np.frombuffer(r["nw"], np.uint8).astype(np.int64)
                    for x in range(0, len(s), 1 << 14):
                        at, many = s[x : x + (1 << 14)], nw[x : x + (1 << 14)]
                        at = np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        c, c2 = digests(text, at, at + size)
                        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(np.full(len(at), i)), pa.array(at)], names=["c", "c2", "d", "s"])

    def blobs(batches):
        for batch in batches:
            d, s = (batch.column(k).to_numpy() for k in range(2))
            ids, got = _by_document(d, s, np.ones(len(s), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(got, pa.binary())], names=["key", "s"])

    rows = saved(asked.mapInArrow(tidy(windows), "c long, c2 long, d long, s long"))
    # Written out, so that the join deals out both sides and can split a window that very many documents hold.
    first = saved(rows.groupBy("c", "c2").agg(F.min(F.struct("d", "s")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = rows.join(first, ["c", "c2"]).where(F.struct("d", "s") != F.col("first")).select("d", "s")
    return later.mapInArrow(tidy(blobs), "key long, s binary")


def _spans(marks: list[bytes] | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes: starts and ends."""
    if not marks:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.sort(np.frombuffer(b"".join(marks), np.int64))
    s = x >> 16
    e = np.maximum.accumulate(s + (x & 0xFFFF) + size - 1)
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], np.append(e[:-1][new[1:]], e[-1])


def deduplicated(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and text as bytes with keep_text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = repeated_windows(docs, size).groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))  # bounded by the document

    def finish(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("n", "r", "k", "h", "t")}
            for k, m in enumerate(batch.column(2).to_pylist()):
                text = data[off[k] : off[k + 1]]
                s, e = _spans(m, size)
                keep, p = [], 0
                for x, y in zip(s.tolist(), e.tolist(), strict=True):
                    keep.append(text[p:x].tobytes())
                    p = y
                left = b"".join([*keep, text[p:].tobytes()])
                for key, v in zip(out, (len(text), len(text) - len(left), len(s), hashlib.sha256(left).hexdigest(), left if keep_text else None), strict=True):
                    out[key].append(v)
            arrays = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["r"], pa.int64()), pa.array(out["k"], pa.int64()), pa.array(out["h"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out["t"], pa.binary())] * keep_text, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return docs.join(marks, "doc_id", "left").select("doc_id", "text", "marks").mapInArrow(tidy(finish), schema)


def cleaned(docs: DataFrame, size: int = 100) -> DataFrame:
    """docs with repeated bytes removed from text (and n_chars counted anew); all columns and rows stay.

    Bytes left over from a character that was cut are dropped with it.
    """
    names = docs.columns
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = repeated_windows(own, size).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("marks").alias("__marks"))  # bounded by the document
    text, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def finish(batches):
        for batch in batches:
            data, off = buffers(batch.column(text))
            out = []
            for k, (m, null) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(text).is_null().to_pylist(), strict=True)):
                own = data[off[k] : off[k + 1]].tobytes()
                s, e = _spans(m, size)
                kept = b"".join(own[p:q] for p, q in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True))
                out.append(None if null else kept.decode("utf-8", "ignore"))
            cols = batch.columns[: len(names)]
            cols[text] = pa.array(out, pa.string())
            if chars is not None:
                cols[chars] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined = docs.join(marks, docs["doc_id"].cast("long") == marks["__id"], "left").select(*[docs[c] for c in names], "__marks")
    return joined.mapInArrow(tidy(finish), docs.schema)
