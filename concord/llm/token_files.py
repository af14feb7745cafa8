"""Token ids in flat binary files with 64-bit document offsets."""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import text_total
from .hashing import SEPARATOR, text_bytes
from .shared import at_exit, local, shared_folder

_PART = "part long, n_docs long, n_tokens long, path string"
_BLOCK = 8 << 20
#: What a tokenizer must do with a text for cut_units to be right; fixed values, as its file has them.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PIECES = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_SPACE, _LETTER, _DIGIT, _OTHER, _QUOTE, _MARK = range(6)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether a text may be cut between bytes of two classes."""
    kind = np.full(256, _OTHER, dtype=np.uint8)
    for i in range(128):
        kind[i] = _LETTER if chr(i).isalpha() else _DIGIT if chr(i).isdigit() else _MARK
    kind[ord("'")] = _QUOTE
    kind[SEPARATOR] = _SPACE
    cut = np.zeros((6, 6), dtype=bool)
    cut[_SPACE, :] = cut[:, _SPACE] = True
    known = [_LETTER, _DIGIT, _QUOTE, _MARK]
    cut[_DIGIT, known] = cut[known, _DIGIT] = True  # a digit is a token of its own
    cut[_LETTER, _MARK] = cut[_MARK, _LETTER] = True
    cut[_SPACE, _SPACE] = False
    return kind, cut.ravel()


_KIND, _CUT = _classes()


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of every byte; letters U+00C0 to U+017F are letters with both their bytes, all else beyond ASCII is other."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    if len(lead):
        code = (data[lead].astype(np.int32) & 31) << 6 | data[lead + 1] & 63
        lead = lead[~np.isin(code, (0xD7, 0xF7, 0x130))]  # two signs, and the letter that becomes two characters in lower case
        kind[lead] = kind[lead + 1] = _LETTER
    return kind


def cut_units(data: np.ndarray, offs: np.ndarray, whole: list[bytes] = ()) -> tuple[pa.Array, np.ndarray]:
    """Units of texts that lie end to end, and the number of units before each text.

    White space is left out.  Texts are cut where the tokenizer cuts them whatever is
    around: at white space, around ASCII digits, and between letters and ASCII marks but for the
    apostrophe, which may begin a contraction.  Strings in `whole` (added tokens) stay in one unit.
    """
    kind = byte_classes(data)
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    if whole:
        raw = data.tobytes()
        for token in whole:
            at = raw.find(token)
            while at >= 0:
                edge[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
    edge[offs] = True
    start = np.flatnonzero(edge[:-1])
    word = kind > _SPACE
    size = np.diff(np.append(start, len(data)))
    start, size = start[word[start]], size[word[start]]
    ends = np.concatenate(([0], np.cumsum(size)))
    units = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[word]))])
    return units, np.searchsorted(start, offs)


class Encoder:
    """Ids of texts, end_id behind each.

    A tokenizer of the known kind (see cut_units) encodes each distinct unit once, and
    keeps at most `most` of them; any other encodes whole texts.
    """

    def __init__(self, path: str, end_id: int, most: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.end, self.most = Tokenizer.from_file(path), end_id, most
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        told = json.loads(self.model.to_str())
        added = told.get("added_tokens") or []
        split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        rest = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        self.by_unit = (
            (told.get("normalizer") or {}).get("normalizers") == _NORMAL and split[0] == _PIECES and len(split) == 2 and rest.items() <= split[1].items()
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
            and not told.get("truncation") and not told.get("padding")
        )
        self.whole = [t["content"].encode() for t in added]
        self.forget()

    def forget(self) -> None:
        self.known, self.flat, self.ends = pa.array([], pa.large_string()), np.empty(0, self.kind), np.zeros(1, dtype=np.int64)

    def learn(self, units: pa.Array) -> None:
        parts, counts = [self.flat], []
        for a in range(0, len(units), 4096):
            for e in self.model.encode_batch_fast(units.slice(a, 4096).to_pylist(), add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                parts.append(ids)
        self.flat = np.concatenate([np.asarray(p, dtype=self.kind) for p in (parts[0], [i for p in parts[1:] for i in p])])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts, dtype=np.int64))
        self.known = pa.concat_arrays([self.known, units])

    def texts(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts end to end, and where each text's end."""
        if not self.by_unit:
            encoded = [[*e.ids, self.end] for e in self.model.encode_batch_fast(column.to_pylist(), add_special_tokens=False)]
            return np.array([i for e in encoded for i in e], dtype=self.kind), np.cumsum([len(e) for e in encoded], dtype=np.int64)
        units, first = cut_units(*text_bytes(column), self.whole)
        named = units.dictionary_encode()
        words = named.dictionary
        at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            new = words.filter(pc.is_null(at))
            if len(self.known) + len(new) > self.most:
                self.forget()
                new = words
            self.learn(new)
            at = pc.index_in(words, value_set=self.known)
        unit = at.to_numpy(zero_copy_only=False).astype(np.int64)[named.indices.to_numpy()]
        begin = self.ends[unit]
        size = self.ends[unit + 1] - begin
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(before[-1]) + np.repeat(begin - before[:-1], size)]
        ends = before[first[1:]]
        return np.insert(ids, ends, self.end), ends + np.arange(1, len(ends) + 1)


@functools.lru_cache(maxsize=1)
def encoder_of(folder: str, path: str, end_id: int, most: int) -> Encoder:
    """The encoder that tasks of one Python worker share while they write one folder, so a unit is encoded once a worker, not once a task; another folder starts anew."""
    return Encoder(path, end_id, most)


def write_tokens(
    docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", bytes_per_part: int = 24 << 20, cache_units: int = 600_000
) -> DataFrame:
    """Write every text's token ids, then end_id, in ascending id order; return the parts: part, n_docs, n_tokens, path, base.

    Format of a part, all little-endian: `path`.ids, unsigned integers without a
    header (16 bits if the vocabulary fits, else 32: the extension says u16 or u32);
    `path`.off, n_docs + 1 64-bit offsets into it, counted in ids from the part's
    start; `path`.doc, the 64-bit document ids.  Laid end to end in order of part,
    the ids of all parts are those of the corpus; base, the prefix sum of n_tokens,
    is where a part begins.

    Ranges of ids make the parts, of about bytes_per_part bytes of text; inside a
    part rows are sorted by id and text, so repeated ids have one order.  A part is
    written under a name of its own attempt, synced, and named in the returned table
    only by the attempt that counts, so lost or doubled attempts do no harm.  A tokenizer that
    cuts texts as cut_units does encodes each distinct unit once in each Python worker (a table of at most cache_units,
    emptied when full), and ids are laid out by array operations; any other encodes whole
    texts.  Null texts are empty; null ids come first, kept as the least 64-bit integer.
    """
    spark = docs.sparkSession
    rows, size = text_total(docs, F.col(text_col))
    n_parts = max(1, -(-(size + 16 * rows) // bytes_per_part))
    where = local(folder)
    os.makedirs(where, exist_ok=True)
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = slim.repartitionByRange(n_parts, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def encode(batches):
        encoder = encoder_of(where, tokenizer, end_id, cache_units)
        path = None
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            block = (np.cumsum(sizes) - sizes) // _BLOCK  # rows whose texts begin in the same 8 MB
            cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if path is None:
                    number = TaskContext.get().partitionId()
                    path = f"{where}/part-{number:06d}-{uuid.uuid4().hex}"
                    files = [open(f"{path}.{x}", "wb") for x in (f"u{encoder.kind.itemsize * 8}", "off", "doc")]  # noqa: SIM115
                    n_docs = n_tokens = 0
                    files[1].write(np.zeros(1, "<i8").tobytes())
                ids, ends = encoder.texts(batch.column("text").slice(a, b - a))
                files[0].write(ids.tobytes())
                files[1].write((n_tokens + ends).astype("<i8").tobytes())
                files[2].write(batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_tokens = n_docs + len(ends), n_tokens + len(ids)
        if path is not None:
            for f in files:
                f.flush()
                os.fsync(f.fileno())
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "n_docs": [n_docs], "n_tokens": [n_tokens], "path": [path]}, schema=pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("path", pa.string())]))

    # one row for each part; writing the table runs the encoder once, and only rows of attempts that count are in it
    table = f"{folder}/parts"
    ranged.mapInArrow(encode, _PART).write.mode("overwrite").parquet(table)
    parts = spark.read.schema(_PART).parquet(table)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(parts: DataFrame, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Read the files of write_tokens through memory maps: id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as 32-bit integers), and with_ids the ids."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path = row["path"]
                kind = "u16" if os.path.exists(f"{path}.u16") else "u32"
                ids = np.memmap(f"{path}.{kind}", "<u2" if kind == "u16" else "<u4", "r") if row["n_tokens"] else np.empty(0, "<u4")
                off, doc = np.fromfile(f"{path}.off", "<i8"), np.fromfile(f"{path}.doc", "<i8")
                for a in range(0, len(doc), 1024):
                    z = min(a + 1024, len(doc))
                    pieces = [ids[off[i] : off[i + 1]].astype("<u4") for i in range(a, z)]
                    out = {
                        id_col: pa.array(doc[a:z], mask=doc[a:z] == -(1 << 63)),
                        "start": pa.array(off[a:z] + row["base"]),
                        "n_tokens": pa.array(np.diff(off[a : z + 1])),
                        "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([p.tolist() for p in pieces], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = max(1, parts.count())
    return parts.repartition(n, "part").mapInArrow(read, schema)


def token_digest(docs: DataFrame, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus to a new folder under the shared one, and digest it from there; the folder goes, with what failed attempts left in it, when the driver ends."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    at_exit(docs.sparkSession, folder)
    return read_tokens(write_tokens(docs, folder, tokenizer=tokenizer, end_id=end_id, id_col=id_col, text_col=text_col), id_col=id_col)
