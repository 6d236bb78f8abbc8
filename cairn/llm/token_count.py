"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both encodings agree.

A boundary is proven stable if the character before it is no space (nor U+2581 itself) and the one after it is a space: the library writes a
space as U+2581, and `proof` checks at load that no piece of the vocabulary holds U+2581 after another character. No
merge can then cross such a boundary, so the pieces on its two sides depend on their own side only.

A chunk and its successor overlap; they are spliced at the last boundary in the overlap which is stable and where both
encodings begin a piece. If the overlap holds none (a long run without spaces, or one long run of spaces), it is doubled
and both chunks are encoded anew, up to the whole rest of the text. Null counts as empty: no bytes, no tokens. A repeated row
gives a repeated result, a null doc_id stays null, an empty table gives no rows. Only doc_id and text are read, so further columns
of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of more characters are encoded in chunks.
CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
TOKEN_LIMIT = 4096
SPACE_PIECE = "▁"
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint"


def processor(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, proof(model)


def proof(model) -> bool:
    """Whether boundaries before a space are stable: no piece holds the space mark after another character."""
    return not any(SPACE_PIECE in model.id_to_piece(i).lstrip(SPACE_PIECE) for i in range(model.get_piece_size()))


def _starts(model, text: str, first: bool) -> list[int]:
    """Character offset in text at which each token begins; the mark that the library puts before a text belongs to the first chunk only."""
    if first:
        return [begin for begin, _ in model.encode(text, return_type="offset_mapping")["offsets"]]
    # A chunk begins with a space after a non-space: an inserted mark would join that space, so a guard letter takes it.
    offsets = model.encode("a" + text, return_type="offset_mapping")["offsets"]
    return [begin - 1 for begin, _ in offsets if begin >= 1]


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) and text[at] == " " and text[at - 1] not in (" ", SPACE_PIECE)


def count_chunked(model, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int]:
    """(tokens, chunks) of a text, from chunks spliced at stable common boundaries."""
    total = chunks = begin = 0
    size = len(text)
    while begin < size:
        wide = overlap
        while True:
            end = min(size, begin + chunk + wide)
            left = _starts(model, text[begin:end], begin == 0)
            chunks += 1
            if end == size:
                return total + len(left), chunks
            # The next chunk starts at the first stable place of the overlap, and runs through its end.
            low = end - wide
            from_ = next((i for i in range(low, end) if _stable(text, i)), None)
            if from_ is not None:
                right = {from_ + s for s in _starts(model, text[from_:end], False)}
                common = [begin + s for s in set(left) if begin + s in right and _stable(text, begin + s)]
                if common:
                    cut = max(common)
                    total += sum(begin + s < cut for s in left)
                    begin = cut
                    break
            wide *= 2
    return total, chunks


def count(model, stable: bool, text: str) -> tuple[int, int]:
    if not stable or len(text) <= CHUNK_CHARS:
        return (len(model.encode(text)), 1) if text else (0, 0)
    return count_chunked(model, text)


def count_tokens(documents: DataFrame, model_path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of documents (doc_id, text). model_path names a sentencepiece model that every executor can open, by default the installed piece_bpe_32k.model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model_path
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("piece_bpe_32k.model"))
        model, stable = processor(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [count(model, stable, t) for t in texts]
            n = pa.array([c[0] for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), n, pa.compute.greater(n, limit), pa.array([c[1] for c in counts], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
