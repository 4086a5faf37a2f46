"""Encoding of a corpus with a public byte-level BPE vocabulary, each content-defined chunk once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.runs import map_sorted_runs
from ..operators.skew import lookup
from ..session import stage

# Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WINDOW = 16  # characters that decide whether a chunk ends


def chunk_ends(text: str, mean: int = 512, least: int = 64) -> list[int]:
    """Where chunks end: after characters whose rolling hash over the last ``WINDOW`` ones hits, ``least`` apart or more.

    What precedes a window has no say, so copies of a passage are cut alike wherever they stand. The last chunk ends with
    the text; an empty text has none.
    """
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    h = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    power, width = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while width < WINDOW:
            h[width:] += h[:-width] * power
            power, width = power * power, width * 2
    hits = np.flatnonzero((h >> np.uint64(32)) % np.uint64(mean) == 0) + 1
    ends, last = [], 0
    for e in hits[hits >= WINDOW].tolist():
        if e - last >= least and e < len(c):
            ends.append(e)
            last = e
    return [*ends, len(c)] if len(c) else []


class Encoder:
    """Pieces of a text and their ids; pieces met before are looked up."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import base64

        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pieces = regex.compile(pattern)
        self._known: dict[str, list[int]] = {}

    def ids(self, piece: str) -> list[int]:
        found = self._known.get(piece)
        if found is None:
            if len(self._known) > 300_000:
                self._known.clear()
            found = self._bpe.encode_ordinary(piece)  # a piece on its own is one piece again
            if len(piece) < 40:
                self._known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.pieces.finditer(text):
            out += self.ids(m.group())
        return out

    def text(self, ids: list[int]) -> str:
        """The text that these ids stand for: byte-level ids lose nothing."""
        return self._bpe.decode_bytes(ids).decode()

    def chunk(self, text: str) -> tuple[list[int], int, int]:
        """(ids, where the last two pieces begin, how many ids they have): what follows the chunk can change no earlier piece."""
        out: list[int] = []
        begin, count = [0, 0], [0, 0]
        for m in self.pieces.finditer(text):
            begin, count = [begin[1], m.start()], [count[1], len(out)]
            out += self.ids(m.group())
        return out, begin[0], len(out) - count[0]

    def join(self, parts: list[tuple[list[int], int, int]]) -> list[int]:
        """Ids of the concatenated chunks, each given as ``chunk`` has it; their texts come back from their ids.

        At every join the text from the last sure piece on is split again, next to the splitting of the new chunk alone,
        until both have a boundary at the same place; from there on they agree for good, because a match of the pattern
        depends only on what follows its start. Without agreement before the new chunk's own tail the join stays open.
        """
        out: list[int] = []
        pending = ""
        if len(parts) == 1:
            return parts[0][0]
        for ids, tail, tail_ids in parts:
            text = self.text(ids)
            joint, shift = pending + text, len(pending)
            together, alone = self.pieces.finditer(joint), self.pieces.finditer(text)
            a, b, done, skipped, agreed = 0, shift, [], 0, False
            while b <= shift + tail:
                if a == b:
                    agreed = True
                    break
                if a < b:
                    m = next(together, None)
                    if m is None:
                        break
                    done += self.ids(m.group())
                    a = m.end()
                else:
                    m = next(alone, None)
                    if m is None:
                        break
                    skipped += len(self.ids(m.group()))
                    b = shift + m.end()
            if agreed:
                out += done
                out += ids[skipped : len(ids) - tail_ids]
                pending = text[tail:]
            else:
                pending = joint
        return out + self.encode(pending)


def encode_corpus(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", mean: int = 512, hot: int = 50_000) -> DataFrame:
    """(doc_id, ids): the ids of every text, special tokens' strings being ordinary text; one row per input row.

    Texts are cut into content-defined chunks, each distinct chunk is encoded once, and the chunk joins of every text are
    repaired until exact. Chunks are compared by a 128-bit digest, and only ids travel on: a chunk's text follows from them. The ids of a chunk
    that stands in more than ``hot`` places are broadcast, so boilerplate is no hot key. Null and empty texts have no chunk and give an empty list; repeated rows
    and null or repeated doc_ids keep their rows; an empty table gives none. The vocabulary is read by the driver and sent
    along (under 1 MB for byte_bpe_50k).
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast({"ranks": f.read()})
    id_type = dict(docs.select(F.col(doc_id).alias("d")).dtypes)["d"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, pos, key, chunk = [], [], [], []
            for i, t in enumerate(batch.column("t").to_pylist()):
                at = 0
                for p, e in enumerate(chunk_ends(t, mean) or [0]):
                    line.append(i), pos.append(p), chunk.append(t[at:e]), key.append(hashlib.blake2b(t[at:e].encode(), digest_size=16).digest() if e else None)
                    at = e
            take = pa.array(line, pa.int32())
            own = [batch.column(c).take(take) for c in ("row", "d")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int32()), pa.array(key, pa.binary()), pa.array(chunk, pa.string())], names=["row", "d", "pos", "key", "chunk"])

    def encoder() -> Encoder:
        held = ranks.value  # kept by the worker, and the encoder with it
        if "encoder" not in held:
            held["encoder"] = Encoder(held["ranks"])
        return held["encoder"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for batch in batches:
            done = [e.chunk(t) for t in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n"), pa.array([d[0] for d in done], pa.list_(pa.int32())), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())],
                names=["key", "n", "ids", "tail", "tail_ids"],
            )

    def repair(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        e = encoder()
        for at in range(0, len(starts), 2_000):
            some = starts[at : at + 2_000]
            end = starts[at + 2_000] if at + 2_000 < len(starts) else table.num_rows
            part = table.slice(some[0], end - some[0])
            ids, tail, tail_ids = (part.column(c).to_pylist() for c in ("ids", "tail", "tail_ids"))
            cuts = [*(some - some[0]).tolist(), part.num_rows]
            out = [e.join(list(zip(ids[i:j], tail[i:j], tail_ids[i:j], strict=True))) if ids[i] is not None else [] for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("d").combine_chunks().take(pa.array(cuts[:-1])), pa.array(out, pa.list_(pa.int32()))], names=["d", "ids"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chunks = stage(numbered.mapInArrow(cut, f"row long, d {id_type}, pos int, key binary, chunk string"), "chunks")
    distinct = chunks.where("key IS NOT NULL").groupBy("key").agg(F.any_value("chunk").alias("chunk"), F.count("*").alias("n"))
    encoded = stage(distinct.mapInArrow(encode, "key binary, n long, ids array<int>, tail int, tail_ids int"), "encoded")
    heavy = encoded.where(F.col("n") > hot)  # at most one for every ``hot`` chunks
    placed = lookup(chunks.select("row", "d", "pos", "key"), encoded.drop("n"), "key", heavy).select("row", "d", "pos", "ids", "tail", "tail_ids")
    return map_sorted_runs(placed, ["row"], ["pos"], repair, f"d {id_type}, ids array<int>", rows=4_000).withColumnRenamed("d", doc_id)
