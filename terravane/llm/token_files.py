"""Token ids as flat unsigned files with 64-bit document offsets, read back through a memory map.

Format: a folder with, for each range of ascending ids, `part-NNNNN.ids` (little-endian unsigned
integers, 16 bits wide if the vocabulary fits, else 32), `part-NNNNN.offsets` (n + 1 little-endian
unsigned 64-bit offsets in ids, from the start of the part), `part-NNNNN.docs` (n 64-bit document
ids, and n bytes that are 1 where that id is null), and `index.json` (width, and for each part its
documents, its ids and the base of its first id in the whole corpus, from prefix sums of the totals).
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terravane.llm.common import Scratch, Texts, id_and_text, open_folder
from terravane.llm.prefix_sums import bases
from terravane.llm.token_count import REMEMBERED, Memory, pre_tokens


#: Bytes of text that a part is meant for.
PART = 256 << 20


class _Encoder:
    """The library's ids of a text, from what the library gives for each distinct pre-token."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special = set(special)
        self.end = np.array([end_id], self.type).tobytes()
        self.memory = Memory(2 * REMEMBERED)

    def pieces(self, text: str) -> list[str]:
        if self.split is None or self.split.search(text) is None:
            return pre_tokens(text)
        return [x for p in self.split.split(text) for x in ([p] if p in self.special else pre_tokens(p))]

    def _make(self, new: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(new), 50_000):
            own = new[k : k + 50_000]
            e = self.library.encode(own, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, self.type).tobytes()
            cuts = (np.r_[0, np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(own)))] * self.type.itemsize).tolist()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.pieces(t) for t in texts]
        seen = self.memory.of(parts, self._make)
        return [b"".join(map(seen.__getitem__, p)) + self.end for p in parts]


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> _Encoder:
    return _Encoder(path, end_id)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0, parts: int | None = None) -> list[dict]:
    """Encode every whole text, append end_id, and write the files of this module's format; returns the index.

    Texts are dealt by ranges of the id and a hash of the text, so that rows of one id or of none spread too, and sorted
    (null ids come first), then encoded as a stream: a task holds one Arrow batch. Where `parts` is not given there are as many as
    the session shuffles to, or more where that would make parts of over PART bytes. A task writes to files of its own attempt and renames
    them at its end, so that a task that runs again, or twice, leaves the same files. Null texts
    are empty and have only end_id; an empty table writes an index of no parts.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = id_and_text(docs, id_col, text_col)
    if not parts:
        n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // PART))
    by = ("doc_id", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by, "text")

    def write(it):
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        encode = _encoder(path, end_id)
        at, base = open_folder(folder)
        at.create_dir(base, recursive=True)
        name = f"{base}/part-{part:05d}"
        attempt = f"{base}/attempt-{part:05d}-{context.taskAttemptId()}"
        out = {x: at.open_output_stream(f"{attempt}.{x}") for x in ("ids", "offsets", "docs")}
        out["offsets"].write(np.zeros(1, "<u8").tobytes())
        total, rows, nulls = 0, 0, []
        for batch in it:
            texts, column = Texts(batch.column(1)), batch.column(1).fill_null("")
            for i, j in texts.pieces(1 << 20):
                ids = encode(column.slice(i, j - i).to_pylist())
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // encode.type.itemsize
                out["ids"].write(b"".join(ids))
                out["offsets"].write((total + np.cumsum(sizes)).astype("<u8").tobytes())
                total += int(sizes.sum())
            own = batch.column(0)
            nulls.append(np.asarray(own.is_null().to_numpy(zero_copy_only=False), np.uint8))
            out["docs"].write(own.fill_null(0).to_numpy().astype("<i8").tobytes())
            rows += batch.num_rows
        out["docs"].write(b"".join(x.tobytes() for x in nulls))
        for x, f in out.items():
            f.close()
            at.move(f"{attempt}.{x}", f"{name}.{x}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": pa.array([rows], pa.int64()), "ids": pa.array([total], pa.int64())})

    made = sorted((tuple(r) for r in dealt.mapInArrow(write, "part int, docs long, ids long").collect()), key=lambda r: r[0])  # a row for each part
    made = [r for r in made if r[1]]
    index = [{"part": p, "docs": d, "ids": i, "base": b} for (p, d, i), b in zip(made, bases([r[2] for r in made]), strict=True)]
    at, base = open_folder(folder)
    at.create_dir(base, recursive=True)
    with at.open_output_stream(f"{base}/index.json") as f:
        f.write(json.dumps({"type": _encoder(path, end_id).type.str, "parts": index}).encode())
    return index


def _map(at, path: str, kind: str) -> np.ndarray:
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with at.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def read_part(folder: str, part: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, document ids and their null marks of a part, mapped, not loaded, where the storage is mounted."""
    at, base = open_folder(folder)
    name = f"{base}/part-{part:05d}"
    offsets = _map(at, f"{name}.offsets", "<u8")
    docs = _map(at, f"{name}.docs", "u1")
    n = len(offsets) - 1
    return _map(at, f"{name}.ids", kind), offsets, docs[: 8 * n].view("<i8"), docs[8 * n :]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""
    at, base = open_folder(folder)
    with at.open_input_file(f"{base}/index.json") as f:
        index = json.loads(f.read())
    kind = index["type"]
    spec = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def read(it) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, offsets, docs, nulls = read_part(folder, part, kind)
                for i in range(0, len(docs), 8192):
                    own = offsets[i : i + 8193].astype(np.int64)
                    crc = [zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                    gone = np.asarray(nulls[i : i + 8192]).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(docs[i : i + 8192], np.int64), mask=gone), pa.array(own[:-1] + first), pa.array(np.diff(own)), pa.array(crc, pa.int64())], schema=pa.schema(spec))

    parts = spark.createDataFrame([(p["part"], p["base"]) for p in index["parts"]], "part int, base long")
    if index["parts"]:
        parts = parts.repartitionByRange(len(index["parts"]), F.col("part"))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the token files of docs into the shared folder and read them back: a row per input row."""
    with Scratch(docs.sparkSession, "tokens") as scratch:
        folder = f"{scratch.folder}/files"
        write_token_files(docs, folder, id_col, text_col, path, end_id)
        scratch.kept.append("files")
    return read_token_files(docs.sparkSession, folder)
