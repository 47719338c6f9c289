"""Token counts of a unigram vocabulary by dynamic programming over a trie of words.

Different words of a slice of texts are walked in sorted order, which is a depth-first walk of their
trie: the forward scores of a shared prefix are computed once and stay on the path, and each
terminal node stores its token count. Scores of the given pieces become log probabilities by rank,
as in Zipf's law; a character without a piece costs one token per byte. Of equal scores the fewer
tokens win. Counts of words are then added up per text.

Edge cases: null and empty texts have no tokens; words of any length are walked whole; repeated rows
count each on its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .cells import slices
from .common import id_and_text

#: Log probability of one byte of a character without a piece.
BYTE_SCORE = -16.0
#: Mark of a word's begin in the pieces.
BEGIN = "▁"
#: Words whose counts a worker keeps.
CACHE_WORDS = 1_000_000
SLICE = 4_000_000


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, float]:
    """Log probability of every ordinary piece of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return {model.id_to_piece(k): -math.log(2.0 - model.get_score(k)) - 1.0 for k in plain}


def count_words(words: list[str], scores: dict[str, float]) -> dict[str, int]:
    """Tokens of each word on its best path; words share the scores of their prefixes."""
    longest = max(map(len, scores))
    path = ""
    best: list[tuple[float, int]] = [(0.0, 0)]  # (score, minus the tokens) of each prefix of the path
    out: dict[str, int] = {}
    get = scores.get
    for word in sorted(words):
        text = BEGIN + word
        depth = 0
        for a, b in zip(path, text):
            if a != b:
                break
            depth += 1
        del best[depth + 1 :]
        for end in range(depth + 1, len(text) + 1):
            size = len(text[end - 1].encode())
            score, tokens = best[end - 1]
            top = (score + size * BYTE_SCORE, tokens - size)
            for begin in range(max(0, end - longest), end):
                gain = get(text[begin:end])
                if gain is not None:
                    score, tokens = best[begin]
                    if (score + gain, tokens - 1) > top:
                        top = (score + gain, tokens - 1)
            best.append(top)
        path = text
        out[word] = -best[-1][1]
    return out


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """`doc_id`, `n_words` and `n_tokens` of every text."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    rows = id_and_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known = pieces(path), _known(path)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                cut = [(t or "").split() for t in batch.column(1).to_pylist()]
                if len(known) > CACHE_WORDS:
                    known.clear()
                fresh = set().union(*cut) - known.keys()
                known.update(count_words(list(fresh), scores))
                columns = [
                    batch.column(0),
                    pa.array(map(len, cut), pa.int64()),
                    pa.array([sum(map(known.__getitem__, words)) for words in cut], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


@functools.lru_cache(maxsize=2)
def _known(path: str) -> dict[str, int]:
    """Counts of words this Python worker has met."""
    return {}
