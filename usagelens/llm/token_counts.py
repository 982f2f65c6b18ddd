"""Token counts of a piece vocabulary with byte fallback, by heap-and-linked-list merging.

The count of a text is its initial symbols less its merges, plus the extra bytes of symbols that the
vocabulary lacks; no identifiers are made. No shuffle: every task counts the texts it reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.bpe import Memo, merge_pairs
from usagelens.llm.common import text_rows

#: what stands for a space inside pieces
_SPACE = "▁"
LIMIT_TOKENS = 4096
_LETTER = r"[^\W\d_]"


def read_pieces(path: str) -> dict[str, int]:
    """Ordinary pieces of a .model file in order of merging; the rank of a piece is its place."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = sorted({model.get_score(i) for i in ids}, reverse=True)
    place = {score: rank for rank, score in enumerate(scores)}
    return {model.id_to_piece(i): place[model.get_score(i)] for i in ids}


class PieceCounter:
    """Counts the tokens of a text. ``pieces``: piece -> rank."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self._pieces = pieces
        longer = [p for p in pieces if len(p) > 1]
        # A text may be cut where no piece reaches across: before a space mark that follows other
        # characters, and around line ends, as far as the vocabulary has no such piece.
        across = any(_SPACE in p.lstrip(_SPACE) for p in longer)
        line = "" if any("\n" in p for p in longer) else "\n"
        # marks that no piece has behind a letter: a run of letters ends before them
        marks = {c for p in pieces for c in p if not c.isalnum() and c != _SPACE}
        marks -= {b for p in longer for a, b in zip(p, p[1:]) if re.match(_LETTER, a)}
        ends = "".join(re.escape(c) for c in sorted(marks))
        unit = f"{_SPACE}*{_LETTER}++(?=[{ends}\n{_SPACE}]|\\Z)|{_SPACE}*[^{_SPACE}{line}]+|{_SPACE}+"
        if not line:
            unit = f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+"
        if across:
            unit = f"[^{line}]+" if line else "(?s:.+)"
        self._units = re.compile(f"{line}|{unit}" if line else unit).findall
        self._counts = Memo(self._count_unit)

    def _count_unit(self, unit: str) -> int:
        pieces = self._pieces
        merged = merge_pairs(list(unit), pieces)
        merges = len(unit) - len(merged)
        # a symbol outside the vocabulary costs its bytes, unless a merge has taken it in
        lost = sum(len(s.encode("utf-8", "surrogatepass")) - 1 for s in merged if len(s) == 1 and s not in pieces)
        return len(unit) - merges + lost

    def count(self, text: str) -> int:
        if not text:
            return 0
        escaped = _SPACE + text.replace(" ", _SPACE)
        return sum(map(self._counts.__getitem__, self._units(escaped)))


def count_tokens(
    docs: DataFrame,
    pieces: dict[str, int],
    limit: int = LIMIT_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    A null text is empty and has no tokens; repeated rows give repeated results; a null id stays null;
    an empty table gives no rows. ``pieces`` goes to every worker: its size is that of the vocabulary file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(shared.value)
        for batch in batches:
            counts = [counter.count(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    rows = text_rows(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
