"""Cross-tokenizer alignment by distinct segments: every document's tokens by two tokenizers, grouped where both end, and how common each linked pair is.

Segments. Space + text is cut before runs of white space, at places (x, c) with x no white space and c one of `break_chars`. Tokenizer A
cuts such places itself before it merges anything (its pattern lets no piece hold white space after another character, and looks ahead inside runs
of white space only). For B the vocabulary is searched at load: no piece holds c after a character that is no white space, so no merge can cross.
Characters that fail this (a carriage return, say) are no places to cut, and if A is not of that kind nothing is cut. So tokens of a
segment do not depend on what stands around it: it is encoded by B behind a guard letter, whose pieces are dropped.

1. Texts are taken in blocks of about BLOCK_BYTES. A block keeps its documents as numbers of its distinct segments, and asks for each distinct segment once,
   in one row for each part of the segments' hashes. Blocks lie in a table bucketed by their number, so the joins below move what is joined to them, not them.
2. A part's task tokenises and aligns each of its distinct segments once, for all blocks, and answers each of them.
3. Blocks meet their answers: token counts, groups and digest of each document, and in how many documents the block has each id pair.
4. Documents by pair are summed over all blocks, with the highest sum of each A id; each block gets the numbers of its pairs and sums them by document.

What one task holds: a block, or the distinct segments of one part (the number of parts follows the bytes of text), or one A id's pairs, which the other
vocabulary bounds. A segment is in one row a block at most, however often it occurs. A single text longer than a block is a block of its own.

Null and empty texts, and texts whose tokens do not give back their bytes (U+2581 in the text, say), have no tokens: zeros and ''. Every row is a document,
repeated rows and rows without doc_id too. An empty table gives no rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import shared_folder

BLOCK_BYTES = 16 << 20
#: Bytes of text for each part of the segments.
PART_BYTES = 16 << 20
#: Bytes of lines of groups that are read at a time.
LINE_BYTES = 1 << 20
#: Characters that are cut into segments at a time.
PIECE_CHARS = 1 << 20
SPACE_PIECE = "▁"
_CANDIDATES = " \t\n\x0b\x0c\r"
_GUARD = "a"
_SPLIT = "block bigint, part int, doc_ids array<bigint>, lens binary, data binary, parts binary"
_ANSWER = "block bigint, part int, texts binary"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, shas array<string>, lens binary, data binary, texts binary, pairs array<bigint>, n_docs array<bigint>"
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on in their order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of each id. Paths must be readable on every executor; by default the installed files."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        if path_a is None or path_b is None:
            import public_tokenizers

            path_a, path_b = path_a or str(public_tokenizers.path("byte_bpe_50k.json")), path_b or str(public_tokenizers.path("piece_bpe_32k.model"))
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(self.pieces)]
        self.break_chars = self._breaks(json.loads(self.a.to_str()))
        self.guard = len(self.b.encode(_GUARD))
        self.digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def _breaks(self, a: dict) -> str:
        """White space before which segments may be cut, by A's settings and B's vocabulary."""
        before = a["pre_tokenizer"] or {}
        if a["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            return ""
        inside = [p.replace(SPACE_PIECE, " ") for i, p in enumerate(self.pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossed = {y for p in inside for x, y in zip(p, p[1:]) if not x.isspace()}
        return "".join(c for c in _CANDIDATES if c not in crossed)

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each segment; all begin with white space, as space + text does."""
        a = self.a.encode_batch(segments, add_special_tokens=False)
        if self.break_chars:
            b = [x[self.guard :] for x in self.b.encode([_GUARD + s for s in segments], num_threads=1)]
        else:
            b = self.b.encode([s[1:] for s in segments], num_threads=1)
        return zip((x.ids for x in a), b, strict=True)

    def groups(self, segment: str, a: list[int], b: list[int]) -> str:
        """a1,a2|b1;a3|b2,b3: the tokens between places where both end; '' if they do not give back the segment."""
        whole, of_a, of_b, digits = segment.encode(), self.a_bytes, self.b_bytes, self.digits
        if b"".join([of_a[i] for i in a]) != whole or b"".join([of_b[i] for i in b]) != whole:
            return ""
        out, i, j, end_a, end_b = [], 0, 0, 0, 0
        while i < len(a):
            first_a, first_b = i, j
            end_a += len(of_a[a[i]])
            end_b += len(of_b[b[j]])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += len(of_a[a[i]])
                    i += 1
                else:
                    end_b += len(of_b[b[j]])
                    j += 1
            out.append(",".join([digits[x] for x in a[first_a:i]]) + "|" + ",".join([digits[x] for x in b[first_b:j]]))
        return ";".join(out)


class Cutter:
    """Space + text -> its segments."""

    def __init__(self, chars: str) -> None:
        some = "".join(map(re.escape, chars))
        self.place = re.compile(rf"(?<=\S)(?=[{some}])") if chars else None
        self.plain = re.compile(rf"[{some}]*[^{some}]+|[{some}]+") if chars else None
        self.odd = re.compile(rf"(?![{some}])\s") if chars else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Segments of space + text, some at a time."""
        text = " " + text
        if self.place is None:
            yield [text]
            return
        at = 0
        while at < len(text):
            cut = self.place.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
            end = cut.start() if cut else len(text)
            piece = text[at:end] if at or cut else text
            yield self.place.split(piece) if self.odd.search(piece) else self.plain.findall(piece)
            at = end


def packed(x: np.ndarray) -> bytes:
    """Integers below 2^32, byte by byte of all, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.asarray(x, "<u4").view(np.uint8).reshape(len(x), 4).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, len(planes) // 4).T).view("<u4").ravel()


def _splitter(paths: tuple, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cutter = Cutter(Tokenizers(*paths).break_chars)
        number, names = TaskContext.get().partitionId() << 32, _names(_SPLIT)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        ids, lens, seqs, known, size = [], [], [], {}, 0

        def block() -> Iterator[pa.RecordBatch]:
            """The rows of a block; what it held is forgotten."""
            words = [w.encode() for w in known]
            parts = np.array([zlib.crc32(w) % n_parts for w in words], np.int64)
            order = np.argsort(parts, kind="stable")
            seq = np.concatenate(seqs) if seqs else np.empty(0, np.int32)
            rows = [(number, None, ids.copy(), packed(np.array(lens, np.int64)), packed(seq), packed(parts))]
            for some in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1) if len(order) else []:
                mine = [words[i] for i in some]
                rows.append((number, int(parts[some[0]]), None, packed(np.array([len(w) for w in mine])), b"".join(mine), None))
            for x in (ids, lens, seqs, known):
                x.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text, n = text.as_py() or "", 0
                for piece in cutter.pieces(text) if text else ():
                    seqs.append(np.array([known.setdefault(w, len(known)) for w in piece], np.int32))
                    n += len(piece)
                ids.append(doc_id)
                lens.append(n)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from block()
                    number, size = number + 1, 0
        if ids:
            yield from block()

    return run


def _answerer(paths: tuple):
    """Requests in the order of parts -> the groups of each segment, a line each. Segments of a part are encoded when they first come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(*paths)
        open_part, known = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["part"] != open_part:
                    open_part, known = row["part"], {}
                ends = np.cumsum(unpacked(row["lens"])).tolist()
                words = [row["data"][a:b] for a, b in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in known]
                texts = [w.decode() for w in fresh]
                for w, text, (a, b) in zip(fresh, texts, tokenizers.encode(texts) if texts else (), strict=True):
                    known[w] = tokenizers.groups(text, a, b)
                out.append("\n".join([*[known[w] for w in words], ""]).encode())
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("part"), pa.array(out, pa.binary())], _names(_ANSWER))

    return run


class Segments:
    """What a block's segments say, read from their lines of groups, LINE_BYTES at a time: the arrays for each character and number are several times the lines."""

    def __init__(self, lines: bytes) -> None:
        data, at, runs = np.frombuffer(lines, np.uint8), 0, []
        while at < len(data) or not runs:
            end = lines.find(b"\n", at + LINE_BYTES) + 1 or len(data)
            runs.append(self._read(data[at:end]))
            at = end
        self.counts = {c: np.concatenate([counts[c] for counts, _ in runs]) for c in _COUNTS}
        links = np.concatenate([links for _, links in runs])
        del runs
        self.n = len(self.counts["n_a"])
        self.first = np.concatenate([[0], np.cumsum(self.counts["n_links"])])
        self.good = self.counts["n_a"] > 0
        order = np.argsort(links)
        links = links[order]
        new = np.ones(len(links), bool)
        np.not_equal(links[1:], links[:-1], out=new[1:])
        self.pairs = links[new]
        del links
        self.link = np.empty(len(order), np.int32)
        self.link[order] = np.cumsum(new, dtype=np.int32) - 1

    @staticmethod
    def _read(data: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(counts of each line, A << 32 | B of each link) of whole lines."""
        digit = (data >= 48) & (data <= 57)
        ends = np.flatnonzero(digit[:-1] & ~digit[1:]) + 1  # the mark after each number
        starts = np.concatenate([[0], np.flatnonzero(~digit[:-1] & digit[1:]) + 1]) if len(ends) else np.empty(0, np.int64)
        if len(starts) > len(ends):  # the text does not begin with a number
            starts = starts[1:]
        value, width = np.zeros(len(ends), np.int64), ends - starts
        for k in range(int(width.max(initial=0))):
            inside = k < width
            value[inside] += (data[ends[inside] - 1 - k] - 48).astype(np.int64) * 10**k
        mark = data[ends]
        lines_before = np.cumsum(data == 10, dtype=np.int32)
        n = int(lines_before[-1]) if len(data) else 0
        word = lines_before[ends - 1] if len(ends) else np.empty(0, np.int64)
        closes = (mark == 59) | (mark == 10)
        group = np.cumsum(closes) - closes
        bars = np.cumsum(mark == 124) - (mark == 124)
        second = bars > group  # each group has one bar
        n_groups = int(closes.sum())
        of_a, of_b = np.bincount(group[~second], minlength=n_groups), np.bincount(group[second], minlength=n_groups)
        word_of = word[closes]
        counts = {"n_a": np.bincount(word[~second], minlength=n), "n_b": np.bincount(word[second], minlength=n), "n_groups": np.bincount(word_of, minlength=n)}
        # Every A token with each B token of its group; tokens of a group lie side by side.
        times = of_b[group[~second]]
        counts["n_links"] = np.bincount(word[~second], weights=times, minlength=n).astype(np.int64)
        at = np.arange(int(times.sum()))
        at -= np.repeat(np.cumsum(times) - times - (np.cumsum(of_b) - of_b)[group[~second]], times)
        links = np.repeat(value[~second] << 32, times)
        links |= value[second][at]
        return counts, links


def _documents(lens: np.ndarray, seq: np.ndarray, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """(document of each occurrence, whether each document is encoded whole)."""
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    bad = np.bincount(doc[~segments.good[seq]], minlength=len(lens)) if len(seq) else np.zeros(len(lens), np.int64)
    return doc, (bad == 0) & (lens > 0)


def _by_document(doc: np.ndarray, weights: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Exact integer sums by document; zero where it is not good. Occurrences lie in the order of documents."""
    sums = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=sums[1:])
    ends = np.searchsorted(doc, np.arange(len(good)), "right")
    begins = np.searchsorted(doc, np.arange(len(good)), "left")
    return np.where(good, sums[ends] - sums[begins], 0)


def _compose(block: pa.Table, answers: pa.Table) -> pa.Table:
    """A block and its answers -> the block with its documents' measures and the documents by pair."""
    if not block.num_rows:
        return pa.Table.from_pydict({c: [] for c in _names(_BLOCK)}, schema=_schema())
    row = block.to_pylist()[0]
    lens, seq, parts = unpacked(row["lens"]).astype(np.int64), unpacked(row["data"]), unpacked(row["parts"])
    answers = answers.sort_by("part")
    flat = b"".join(answers.column("texts").to_pylist()).split(b"\n")[:-1]
    texts = [b""] * len(parts)
    for i, text in zip(np.argsort(parts, kind="stable").tolist(), flat, strict=True):
        texts[i] = text
    lines = b"\n".join([*texts, b""])
    del flat, answers
    segments = Segments(lines)
    doc, good = _documents(lens, seq, segments)
    shas, at = [], 0
    for n, ok in zip(lens.tolist(), good.tolist(), strict=True):
        shas.append(hashlib.sha256(b";".join([texts[i] for i in seq[at : at + n].tolist()])).hexdigest() if ok else "")
        at += n
    # Documents of each pair: distinct segments of a document first, then distinct pairs, some documents at a time.
    n_docs, size = np.zeros(len(segments.pairs), np.int64), max(1, len(parts))
    kept = good[doc]
    of, word = doc[kept], seq[kept]
    cuts = np.searchsorted(of, of[np.arange(0, len(of), 1 << 18)]) if len(of) else np.zeros(1, np.int64)
    for low, high in zip(cuts, [*cuts[1:], len(of)], strict=True):
        mine = np.unique((of[low:high] - (of[low] if high > low else 0)).astype(np.int64) * size + word[low:high])
        n = segments.counts["n_links"][mine % size]
        link = segments.link[np.repeat(segments.first[mine % size], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        distinct = np.unique(np.repeat(mine // size, n) * len(segments.pairs) + link)
        n_docs += np.bincount(distinct % len(segments.pairs), minlength=len(n_docs)) if len(distinct) else 0
    seen = n_docs > 0
    values = {"block": [row["block"]], "doc_ids": [row["doc_ids"]]} | {c: [_by_document(doc, segments.counts[c][seq], good)] for c in _COUNTS}
    values |= {"shas": [shas], "lens": [row["lens"]], "data": [row["data"]], "texts": [zstandard.ZstdCompressor(level=1).compress(lines)], "pairs": [segments.pairs[seen]], "n_docs": [n_docs[seen]]}
    return pa.Table.from_pydict(values, schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _BLOCK.split(", ")])


def _finish(block: pa.Table, scores: pa.Table) -> pa.Table:
    """A block and the numbers of its pairs -> the rows of its documents."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _RESULT.split(", ")])
    if not block.num_rows:
        return schema.empty_table()
    row = block.to_pylist()[0]
    lens, seq = unpacked(row["lens"]).astype(np.int64), unpacked(row["data"])
    segments = Segments(zstandard.ZstdDecompressor().decompress(row["texts"]))
    doc, good = _documents(lens, seq, segments)
    pair = scores.column("pair").to_numpy()
    order = np.argsort(pair)
    at = order[np.minimum(np.searchsorted(pair[order], segments.pairs), max(0, len(pair) - 1))] if len(pair) else np.empty(0, np.int64)
    out = {"doc_id": row["doc_ids"]} | {c: row[c] for c in _COUNTS}
    for name, column in (("n_best", "best"), ("count_sum", "n")):
        # A pair of broken documents only has no number, and no document asks for it.
        by_link = scores.column(column).to_numpy()[at][segments.link] if len(pair) else np.zeros(len(segments.link), np.int64)
        sums = np.concatenate([[0], np.cumsum(by_link)])
        by_word = sums[segments.first[1:]] - sums[segments.first[:-1]]
        out[name] = _by_document(doc, by_word[seq], good)
    return pa.Table.from_pydict(out | {"groups_sha256": row["shas"]}, schema=schema)


def _bucketed(df: DataFrame, n: int, name: str) -> DataFrame:
    """df as a table bucketed by block, in the shared folder."""
    name = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, "block").option("path", f"{shared_folder(df.sparkSession)}/{name}").saveAsTable(name)
    return df.sparkSession.table(name)


def align(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of documents (doc_id, text)."""
    session, paths = documents.sparkSession, (path_a, path_b)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    least = int(session.conf.get("spark.sql.shuffle.partitions"))
    n_parts, n_buckets = max(least, total // PART_BYTES), min(100_000, max(least, total // BLOCK_BYTES))
    split = _bucketed(docs.mapInArrow(_splitter(paths, n_parts), _SPLIT), n_buckets, "align_split")
    asked = split.filter(F.col("part").isNotNull()).select("block", "part", "lens", "data").repartition(min(n_parts, 1 << 15), "part").sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(_answerer(paths), _ANSWER)
    blocks = split.filter(F.col("part").isNull()).select("block", "doc_ids", "lens", "data", "parts")
    composed = _bucketed(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_compose, _BLOCK), n_buckets, "align_blocks")
    pairs = composed.select("block", F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n"))
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = counts.withColumn("best", (F.col("n") == highest).cast("long"))
    scores = pairs.select("block", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "pair", "n", "best")
    rows = composed.select("block", "doc_ids", *_COUNTS, "shas", "lens", "data", "texts")
    return rows.groupBy("block").cogroup(scores.groupBy("of_block")).applyInArrow(_finish, _RESULT)
