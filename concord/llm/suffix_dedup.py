"""Suffix-array dedup over bytes by column-wise construction."""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import exchange as X
from .hashing import Family, covered, gram_hashes, text_bytes

_HOT = np.uint64(0xFFFFFFFFFFFFFFFF)
_PIECE = "bucket long, chunk long, keys binary, facts binary, phase int, piece binary, digest binary, left int, windows int, copies int"
_PIECES = pa.schema([
    ("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("facts", pa.binary()), ("phase", pa.int32()), ("piece", pa.binary()), ("digest", pa.binary()), ("left", pa.int32()), ("windows", pa.int32()), ("copies", pa.int32()),
])
#: What a piece is asked for, and phases of the exchange: both widths, the wide one alone, fingerprints of either.
_BOTH, _WIDE, _NARROW_PRINT, _WIDE_PRINT = 2, 3, 4, 5
_REPLY = X.REPLY + ", digest binary, wide binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for every i that has so many values; two passes whatever the width."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = np.full(-(-len(x) // width) * width, x.max() if len(x) else 0, dtype=x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def repeated_windows(pieces: list[bytes], left: np.ndarray, windows: np.ndarray, copies: np.ndarray, widths: tuple[int, ...], spool_bytes: int = 64 << 20) -> list[list[np.ndarray]]:
    """For each of widths: which of each piece's first `windows` strings of that width other pieces hold as well, at the same distance from their anchors.

    Pieces are laid with their anchors (at left) in one column.  The last column
    comes first; each round inserts one symbol a piece in front of its suffix: the
    suffixes' order becomes the stable order of the new symbols over the old order
    (the collection's Burrows-Wheeler transform is the symbols in the old order),
    and the common prefix of neighbours with the same symbol becomes one more than the
    least common prefix between them before.  Neighbours that share width bytes
    hold the same window.  Equal windows have equal anchors, so only suffixes
    of the same round have to be compared, and a round costs one step a piece.
    Columns lie in order of use in an array, or, above spool_bytes, in a temporary
    file that is read sequentially and goes with the call.
    """
    m = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    before = int(left.max())
    columns = before + int((sizes - left).max())
    spool = None
    if m * columns * 2 > spool_bytes:
        spool = tempfile.TemporaryFile()  # noqa: SIM115
        cells = np.memmap(spool, np.uint16, "w+", shape=(columns, m))
    else:
        cells = np.zeros((columns, m), dtype=np.uint16)
    for i, p in enumerate(pieces):  # 0: outside the piece
        a = before - left[i]
        cells[a : a + len(p), i] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
    first = before - left
    found = [np.zeros((int(windows.max()), m), dtype=bool) for _ in widths]
    order, common = np.arange(m), np.zeros(m + 1, dtype=np.int32)
    for c in range(columns - 1, -1, -1):
        symbol = cells[c][order]
        rank = np.argsort(symbol, kind="stable")
        kept = symbol[rank]
        same = np.flatnonzero((kept[1:] == kept[:-1]) & (kept[1:] > 0)) + 1
        order = order[rank]
        longer = np.zeros(m + 1, dtype=np.int32)
        if len(same):
            ends = np.empty(2 * len(same), dtype=np.int64)
            ends[0::2], ends[1::2] = rank[same - 1] + 1, rank[same] + 1
            longer[same] = np.minimum.reduceat(common, ends)[::2] + 1
        common = longer
        if not (common >= widths[0]).any():
            continue
        # of suffixes that begin a window (those behind the last one don't) and their neighbours among these
        w = c - first[order]
        at = np.flatnonzero((w >= 0) & (w < windows[order]))
        if len(at) > 1:
            ends = np.empty(2 * len(at) - 2, dtype=np.int64)
            ends[0::2], ends[1::2] = at[:-1] + 1, at[1:] + 1
            shared = np.minimum.reduceat(common, ends)[::2]
            for width, own in zip(widths, found, strict=True):
                hit = np.flatnonzero(shared >= width)
                for i in (at[hit], at[hit + 1]):
                    own[w[i], order[i]] = True
    if spool is not None:
        del cells
        spool.close()
    several = copies > 1
    for width, own in zip(widths, found, strict=True):
        own[:, several] |= np.arange(len(own))[:, None] + width <= sizes[None, several]
    return [[own[:w, i] for i, w in enumerate(windows)] for own in found]


def suffix_dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 400, report: int | None = None, gram: int = 48, sample: int = 64, chunk_bytes: int = 2 << 20, bucket_bytes: int = 7 << 19, hot_anchor: int = 1000, keep_text: bool = False
) -> DataFrame:
    """Remove every byte that lies in a `width`-byte string that starts anywhere else as well.

    A column-wise suffix array of a whole corpus would take as many rounds over all
    of it as its longest text has bytes, so the corpus is first cut to what can repeat,
    and that is dealt out so that equal strings meet:

    1. every run of `sample` consecutive grams (of `gram` bytes) has its least hash;
       chunks ask how often each occurs.  A string is a candidate if all the
       least hashes within it occur more than once, which is so for any repeated string;
    2. a candidate's anchor is the gram of the least of these hashes that occurs at most
       hot_anchor times.  Adjoining candidates with the same anchor make a piece, which goes to the anchor's
       bucket, so an anchor has that many pieces at most.  There the suffixes of all pieces are sorted by column-wise
       insertion with their common prefixes (repeated_windows): equal strings are neighbours;
    3. candidates all of whose hashes occur more often lie within passages that are repeated
       very often.  Their texts would overfill an anchor's bucket, so they are counted by fingerprints of
       the whole string (two polynomials modulo 2**61 - 1 with bases drawn for each call: no text can be made for which
       different strings agree), combined within chunks.  Stretches of them that are
       equal are looked at once in a chunk, so such a passage costs a chunk what it costs one text.

    report, if given, is a shorter length, for which n_repeated tells how many bytes strings of that length
    that start elsewhere as well cover; nothing is removed for it.  Candidates are then strings of
    that length, and pieces reach as far as the longer strings that begin in them, so one sort serves both.

    Returns a row for each input row: id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256, n_repeated if there is a report, and with keep_text the remaining bytes as binary.
    Matches never cross documents.  Null and empty texts have no bytes.  Repeated
    rows are documents of their own.  Null ids stay null; other columns are left out.
    """
    narrow = width if report is None else report
    if gram + sample - 1 > narrow or narrow > width:
        raise ValueError("a string must hold a run of grams, and the one reported must not be the longer one")
    widths = (narrow,) if narrow == width else (narrow, width)
    chunks, plan = X.in_chunks(docs, id_col, text_col, chunk_bytes=chunk_bytes, keys_per_byte=1.0, bucket_keys=bucket_bytes, row_bytes=60)
    n_buckets = plan.n_buckets
    families = {w: (Family.drawn(), Family.drawn()) for w in widths}

    def least(data, offs):
        """Hashes of grams; of each run of grams its least hash; whether that run lies in one document; the document of each byte."""
        doc = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
        grams = gram_hashes(data, gram)
        runs = sliding_min(grams, sample)
        span = gram + sample - 2
        return grams, runs, doc[span : span + len(runs)] == doc[: len(runs)], doc

    def stretches(runs, whole):
        """Where the least hash changes, and how long it stays."""
        new = np.ones(len(runs), dtype=bool)
        new[1:] = (runs[1:] != runs[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(new)
        return at, np.diff(np.append(at, len(runs)))

    def ask(key, table):
        data, offs = text_bytes(table.column("text"))
        _, runs, whole, doc = least(data, offs)
        at, length = stretches(runs, whole)
        at, length = at[whole[at]], length[whole[at]]
        keys, inverse = np.unique(X.routed(runs[at], n_buckets), return_inverse=True)
        # a gram is least in `sample` runs at most
        times = np.bincount(inverse, -(-length // sample) * table.column("copies").to_numpy()[doc[at]], len(keys))
        return X.messages(key[0].as_py(), keys, times.astype("<u8"))

    def count(key, table):
        keys, ends, facts = X.bucket_keys(table)
        _, inverse = np.unique(keys, return_inverse=True)
        times = np.bincount(inverse, np.frombuffer(b"".join(facts), "<u8"))
        level = (times > 1).astype(np.uint8) + (times > hot_anchor)
        out = X.replies(table, level[inverse], ends, 1)
        return out.append_column("digest", pa.nulls(len(out), pa.binary())).append_column("wide", pa.nulls(len(out), pa.binary()))

    class Candidates:
        """Strings of a chunk that may be repeated, and their anchors."""

        def __init__(self, data, offs, right):
            self.data, self.offs, self.raw = data, offs, data.tobytes()
            self.grams, runs, whole, self.doc = least(data, offs)
            self.at, length = stretches(runs, whole)
            keys, inverse = np.unique(X.routed(runs[self.at[whole[self.at]]], n_buckets), return_inverse=True)
            level = np.zeros(len(self.at), dtype=np.uint8)
            level[whole[self.at]] = X.answered(keys, right, 1, np.uint8)[inverse]
            self.value = runs[self.at]
            self.value[level > 1] = _HOT
            self.runs, self.by_run = runs, np.repeat(self.value, length)
            self.single = np.concatenate(([0], np.cumsum(np.repeat(level == 0, length), dtype=np.int64)))
            # grams that are the least of some run: the greatest of the runs that hold them is not above them
            most = ~sliding_min(~np.concatenate((np.zeros(sample - 1, np.uint64), runs, np.zeros(sample - 1, np.uint64))), sample)
            self.places = np.flatnonzero(self.grams[: len(most)] == most[: len(self.grams)])
            self.at_places = self.grams[self.places]

        def strings(self, size):
            """Starts of candidates of `size` bytes."""
            n, span = len(self.data) - size + 1, size - (gram + sample - 1) + 1
            if n <= 0:
                return np.empty(0, np.int64)
            return np.flatnonzero((self.single[span : span + n] == self.single[:n]) & (self.doc[size - 1 :] == self.doc[:n]))

        def anchors(self, start, size):
            """The place of each candidate's anchor, or -1 where all its hashes are hot."""
            span = size - (gram + sample - 1) + 1
            if not len(start):
                return start
            value = sliding_min(self.by_run, span)[start]
            out = np.full(len(start), -1, dtype=np.int64)
            fine = np.flatnonzero(value != _HOT)
            value, start = value[fine], start[fine]
            # the first stretch in it with that hash, and there the first gram
            i = np.searchsorted(self.at, start, "right") - 1
            todo = np.flatnonzero(self.value[i] != value)
            while len(todo):
                i[todo] += 1
                todo = todo[self.value[i[todo]] != value[todo]]
            run = np.maximum(start, self.at[i])
            j = np.searchsorted(self.places, run)
            todo = np.flatnonzero(self.at_places[j] != value)
            while len(todo):
                j[todo] += 1
                todo = todo[self.at_places[j[todo]] != value[todo]]
            out[fine] = self.places[j]
            return out

        def groups(self):
            """Pieces of candidates with an anchor, each with what it is asked for; and stretches of those that have none."""
            start = self.strings(narrow)
            place = self.anchors(start, narrow)
            pieces = [(_BOTH, *self._pieces(start[place >= 0], place[place >= 0], _BOTH))]
            hot = [(_NARROW_PRINT, narrow, *self._stretches(start[place < 0], narrow))]
            if narrow < width:
                # longer strings that begin with one that is all hot have anchors of their own
                longer = np.intersect1d(self.strings(width), start[place < 0], assume_unique=True)
                place = self.anchors(longer, width)
                pieces.append((_WIDE, *self._pieces(longer[place >= 0], place[place >= 0], _WIDE)))
                hot.append((_WIDE_PRINT, width, *self._stretches(longer[place < 0], width)))
            return pieces, hot

        def _pieces(self, start, place, asked):
            """Adjoining candidates of one anchor: first start, number, distance to the anchor, text as far as the longest string goes, and its digest."""
            new = np.ones(len(start), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(new)
            begin, length = start[at], np.diff(np.append(at, len(start)))
            left = place[at] - begin
            stop = np.minimum(begin + length - 1 + width, self.offs[1:][self.doc[begin]] if len(begin) else 0)
            texts = [self.raw[b:e] for b, e in zip(begin.tolist(), stop.tolist(), strict=True)]
            salts = [x.to_bytes(6, "little") + n.to_bytes(6, "little") + bytes([asked]) for x, n in zip(left.tolist(), length.tolist(), strict=True)]
            return begin, length, left, texts, [hashlib.blake2b(t, digest_size=16, salt=s).digest() for t, s in zip(texts, salts, strict=True)]

        def _stretches(self, start, size):
            """Adjoining candidates without an anchor: first start and number of each; distinct texts' numbers, and these texts."""
            at = np.flatnonzero(np.diff(start, prepend=-2) != 1)
            begin, length = start[at], np.diff(np.append(at, len(start)))
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(self.raw[b : b + n - 1 + size], len(number)) for b, n in zip(begin.tolist(), length.tolist(), strict=True)], dtype=np.int64)
            return begin, length, which, list(number)

    def prints(texts, size):
        """Fingerprints of all strings of `size` bytes of texts, and how many strings each has."""
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        counts = np.array([len(t) - size + 1 for t in texts], dtype=np.int64)
        inside = np.arange(counts.sum()) + np.repeat(ends - counts - size + 1 - (np.cumsum(counts) - counts), counts)
        return (*(f.windows(data, size)[inside] for f in families[size]), counts)

    def deal(key, table, right):
        chunk = key[0].as_py()
        found = Candidates(*text_bytes(table.column("text")), right)
        copied = table.column("copies").to_numpy() > 1
        out = []
        pieces, hot = found.groups()
        for asked, begin, length, left, texts, digests in pieces:
            if not len(begin):
                continue
            seen: dict[bytes, int] = {}
            times: dict[bytes, int] = {}
            for i, (d, c) in enumerate(zip(digests, copied[found.doc[begin]].tolist(), strict=True)):
                seen.setdefault(d, i)
                times[d] = times.get(d, 0) + 1 + c
            own = np.array(list(seen.values()))
            none = pa.nulls(len(own), pa.binary())
            bucket = (X.routed(found.grams[(begin + left)[own]], n_buckets) >> np.uint64(32)).astype(np.int64)
            out.append(pa.table([
                pa.array(bucket), pa.array(np.full(len(own), chunk, np.int64)), none, none, pa.array([asked] * len(own), pa.int32()), pa.array([texts[i] for i in own], pa.binary()), pa.array([digests[i] for i in own], pa.binary()),
                pa.array(left[own].astype(np.int32)), pa.array(length[own].astype(np.int32)), pa.array([times[digests[i]] for i in own], pa.int32()),
            ], schema=_PIECES))
        for phase, size, begin, _, which, texts in hot:
            if not len(begin):
                continue
            h, g, counts = prints(texts, size)
            pairs, many, inverse = X.distinct_pairs(h, g, n_buckets)
            many[inverse[np.repeat(np.bincount(which, 1 + copied[found.doc[begin]]) > 1, counts)]] = True
            sent = X.pair_messages(chunk, pairs, many, n_buckets)
            none = {n: pa.nulls(len(sent), _PIECES.field(n).type) for n in _PIECES.names if n not in sent.column_names}
            none["phase"] = pa.array([phase] * len(sent), pa.int32())
            out.append(pa.table([sent.column(n) if n in sent.column_names else none[n] for n in _PIECES.names], schema=_PIECES))
        return pa.concat_tables(out) if out else _PIECES.empty_table()

    def sort(key, table):
        out, phase = [], table.column("phase")
        for p in (_NARROW_PRINT, _WIDE_PRINT):
            sent = table.filter(pa.compute.equal(phase, p))
            if len(sent):
                hot = X.repeated_pairs(sent, p)
                out.append(hot.append_column("digest", pa.nulls(len(hot), pa.binary())).append_column("wide", pa.nulls(len(hot), pa.binary())))
        for p in (_BOTH, _WIDE):
            sent = table.filter(pa.compute.equal(phase, p))
            if not len(sent):
                continue
            digests, chunk = sent.column("digest").to_pylist(), sent.column("chunk").to_pylist()
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(d, len(number)) for d in digests])
            own = np.unique(which, return_index=True)[1]
            copies = np.bincount(which, sent.column("copies").to_numpy())
            texts = sent.column("piece").take(pa.array(own)).to_pylist()
            bits = repeated_windows(texts, sent.column("left").to_numpy()[own], sent.column("windows").to_numpy()[own], copies, widths if p == _BOTH else (width,))
            told = [[np.packbits(b).tobytes() if b.any() else None for b in one] for one in bits]
            short, wide = told[0], told[-1]
            keep = [i for i, w in enumerate(which) if short[w] is not None or wide[w] is not None]
            out.append(pa.table({
                "chunk": pa.array([chunk[i] for i in keep], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(keep), pa.int64()), "phase": pa.array([p] * len(keep), pa.int32()),
                "reply": pa.array([short[which[i]] for i in keep], pa.binary()), "digest": pa.array([digests[i] for i in keep], pa.binary()), "wide": pa.array([wide[which[i]] for i in keep], pa.binary()),
            }))
        return pa.concat_tables(out)

    def remove(key, table, right):
        data, offs = text_bytes(table.column("text"))
        told = right.filter(pa.compute.is_valid(right.column("digest")))
        answers = dict(zip(told.column("digest").to_pylist(), zip(told.column("reply").to_pylist(), told.column("wide").to_pylist(), strict=True), strict=True))
        starts = {w: [np.empty(0, np.int64)] for w in widths}
        pieces, hot = Candidates(data, offs, right).groups()
        for asked, begin, length, _, _, digests in pieces:
            for b, n, d in zip(begin.tolist(), length.tolist(), digests, strict=True):
                for w, bits in zip(widths if asked == _BOTH else (width,), answers.get(d, ()), strict=False):
                    if bits is not None:
                        starts[w].append(b + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n)))
        for phase, size, begin, length, which, texts in hot:
            if len(begin):
                h, g, counts = prints(texts, size)
                pairs, _, inverse = X.distinct_pairs(h, g, n_buckets)
                repeated = X.answered(X.pair_keys(pairs, n_buckets), right, phase, bool)[inverse]
                from_ = (np.cumsum(counts) - counts)[which]
                at = np.arange(length.sum()) + np.repeat(from_ - (np.cumsum(length) - length), length)
                place = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
                starts[size].append(place[repeated[at]])
        gone = covered(np.concatenate(starts[width]), width, len(data))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offs] = True
        begins = gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1])))
        upto = lambda mask: np.concatenate(([0], np.cumsum(mask)))[offs]
        total = lambda mask: pa.array(np.diff(upto(mask)).astype(np.int64))
        kept, at = data[~gone], upto(~gone)
        parts = [kept[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        out = {"id": table.column("id"), "copies": table.column("copies"), "n_bytes": pa.array(np.diff(offs)), "n_removed": total(gone), "n_spans": total(begins), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())}
        if report is not None:
            out["n_repeated"] = total(covered(np.concatenate(starts[narrow]), narrow, len(data)))
        if keep_text:
            out["kept"] = pa.array(parts, pa.binary())
        return pa.table(out)

    grouped = lambda df: X.by_chunk(df, plan)
    first = grouped(chunks).applyInArrow(ask, X.MESSAGE).groupBy("bucket").applyInArrow(count, _REPLY)
    second = grouped(chunks).cogroup(grouped(first)).applyInArrow(deal, _PIECE).groupBy("bucket").applyInArrow(sort, _REPLY)
    schema = "id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * (report is not None) + ", kept binary" * keep_text
    out = grouped(chunks).cogroup(grouped(first.unionAll(second))).applyInArrow(remove, schema)
    return X.each_copy(out).withColumnRenamed("id", id_col)
