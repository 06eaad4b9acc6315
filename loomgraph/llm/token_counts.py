"""Token counts: pieces are counted once for each distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops

_PRETOKEN = re.compile(" +[^ ]*")


class PieceCounter:
    """Numbers of pieces of pre-tokens: a run of spaces and what follows it up to the next space.

    No piece of the vocabulary may hold a space mark after another character; then no merge crosses the
    start of a pre-token and the counts of a text's pre-tokens add up to that of the text. The table of
    known pre-tokens keeps at most `keep` entries; others are counted once in each slice of texts.
    """

    def __init__(self, path: str, keep: int = 400_000):
        import sentencepiece

        self.model, self.keep, self.known = sentencepiece.SentencePieceProcessor(model_file=path), keep, {}
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of this model cross pre-tokens")

    def totals(self, texts: list[str]) -> list[int]:
        freqs = [Counter(_PRETOKEN.findall(" " + t.replace("▁", " "))) if t else Counter() for t in texts]
        need = set().union(*freqs).difference(self.known)
        fresh = {" ": 1} if " " in need else {}
        need.discard(" ")
        todo = list(need)
        for i in range(0, len(todo), 20_000):
            some = todo[i : i + 20_000]
            fresh.update(zip(some, map(len, self.model.encode([p[1:] for p in some], num_threads=1)), strict=True))
        if len(self.known) + len(fresh) <= self.keep:
            self.known.update(fresh)
        known = self.known
        return [sum(n * (known[p] if p in known else fresh[p]) for p, n in f.items()) for f in freqs]


def token_counts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", most: int = 4096) -> DataFrame:
    """Tokens of every whole text by a sentencepiece BPE model, without begin or end tokens.

    Columns: key, n_bytes, n_tokens, over_limit (n_tokens > most). A null text counts as empty: 0 bytes, 0
    tokens. Rows are independent: repeated rows and null keys come back as they are, an empty table gives
    none, other columns are ignored. No shuffle: each task counts the distinct pre-tokens of its own texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = textops.cached(("pieces", model), lambda: PieceCounter(model))
        for part in textops.slices(batches, "text"):
            texts = part.column("text")
            n = np.array(counter.totals([t or "" for t in texts.to_pylist()]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(textops.lengths(texts)), pa.array(n), pa.array(n > most)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
