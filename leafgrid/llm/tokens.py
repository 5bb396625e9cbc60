"""Operator 8: token counts by the vocabulary's own method: a count-only Viterbi search for unigram vocabularies, merges for BPE.

The vocabulary (pieces and scores of a sentence-piece file; its path is a parameter, the file stays where it is) becomes an
Aho-Corasick automaton. For each end of a match, dynamic programming keeps the best score of a segmentation up to there and its
number of pieces, nothing else. Ties go as in the public unigram tokenizers: of equal scores at one end the piece that starts first
(the longest) stays; a character that no single-character piece covers may be an unknown, at the lowest score less 10; an unknown counts as its
UTF-8 bytes where the vocabulary has byte pieces, else runs of unknowns count once.

The scores of a BPE file are ranks of merges, so a best sum over them isn't its tokenizer's segmentation. With ``own_method`` such a
file is applied by its merges instead: of all neighbours that make up a piece, those of the highest score become one, the leftmost
first, until none are left; characters without a piece count as above.

No piece crosses the border between a word and the white space after it (checked when the vocabulary is read; if one does,
texts are searched whole), nor a character that occurs in no longer piece. So a text's count is the sum over its segments,
whose counts stay in a bounded memo per worker.

Defined cases: null and empty texts have 0 tokens; a text of any length is counted whole; a null doc_id is passed through, ids may be of any type; repeated rows are counted each; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass
class Vocabulary:
    pieces: dict[str, float]
    byte_fallback: bool
    dummy_prefix: bool = True
    squeeze: bool = False
    merges: bool = False
    unknown: float = field(init=False)

    def __post_init__(self) -> None:
        self.unknown = min(self.pieces.values(), default=0.0) - 10
        self.divisible = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.inner = {c for p in self.pieces if len(p) > 1 for c in p}


def read(path: str, own_method: bool = False) -> Vocabulary:
    """Pieces, scores and the normaliser's switches of a sentence-piece file; read as unigram scores unless own_method, which goes by the file's type."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {s.id_to_piece(i): s.get_score(i) for i in range(s.get_piece_size()) if not (s.is_unknown(i) or s.is_control(i) or s.is_byte(i) or s.is_unused(i))}
    fallback = any(s.is_byte(i) for i in range(s.get_piece_size()))
    seen = s.normalize("a  b")
    merges = False
    if own_method:
        model = sentencepiece_model_pb2.ModelProto.FromString(s.serialized_model_proto())
        if model.trainer_spec.model_type not in (model.trainer_spec.UNIGRAM, model.trainer_spec.BPE):
            raise ValueError(f"{path} is neither a unigram nor a BPE file")
        merges = model.trainer_spec.model_type == model.trainer_spec.BPE
    return Vocabulary(pieces, fallback, seen.startswith(SPACE), SPACE * 2 not in seen, merges)


class Counter:
    """Counts of segments under one vocabulary; made once per worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for p, score in vocabulary.pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary.pieces if len(p) == 1}
        # a segment: white space and the word after it
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n") if "\n" not in vocabulary.inner else re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.new, self.old = {}, {}

    def search(self, segment: str) -> int:
        """Pieces of the best segmentation."""
        if self.v.merges:
            return self.merge(segment)
        n, v = len(segment), self.v
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        unknown = [False] * (n + 1)
        matches = [[] for _ in range(n)]
        for end, m in self.automaton.iter(segment):
            matches[end].append(m)
        for e in range(1, n + 1):
            best, pieces, fresh = None, 0, False
            for length, s in sorted(matches[e - 1], reverse=True):
                if best is None or score[e - length] + s > best:
                    best, pieces, fresh = score[e - length] + s, count[e - length] + 1, False
            c = segment[e - 1]
            if c not in self.single and (best is None or score[e - 1] + v.unknown > best):
                best = score[e - 1] + v.unknown
                pieces = count[e - 1] + (len(c.encode()) if v.byte_fallback else 0 if unknown[e - 1] else 1)
                fresh = True
            score[e], count[e], unknown[e] = best, pieces, fresh
        return count[n]

    def merge(self, segment: str) -> int:
        """Pieces that are left when no neighbours can be merged."""
        pieces, n = self.v.pieces, len(segment)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the piece that starts at each place; 0 where none starts any more

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (s := pieces.get(segment[i : end[j]])) is not None:
                heapq.heappush(waiting, (-s, i, j, end[j]))

        waiting: list[tuple[float, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, j, k = heapq.heappop(waiting)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        count, i, unknown = 0, 0, False
        while i < n:
            fresh = end[i] == i + 1 and segment[i] not in self.single
            if not fresh:
                count += 1
            elif self.v.byte_fallback:
                count += len(segment[i].encode())
            elif not unknown:
                count += 1
            unknown, i = fresh, end[i]
        return count

    def segment(self, s: str) -> int:
        n = self.new.get(s)
        if n is None:
            n = self.old.get(s)
            if n is None:
                n = self.search(s)
            if len(self.new) >= common.MEMO_LIMIT:
                self.old, self.new = self.new, {}
            self.new[s] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.v.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        text = (" " if self.v.dummy_prefix and text else "") + text
        text = text.replace(" ", SPACE)
        if not (self.v.divisible and self.v.byte_fallback):
            return self.search(text)
        known = self.new
        total = 0
        for s in self.cut.findall(text):
            n = known.get(s)
            if n is None:
                n = self.segment(s)
                known = self.new
            total += n
        return total


def count(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        counter = v.__dict__.get("counter") or v.__dict__.setdefault("counter", Counter(v))  # stays with the worker
        for b in batches:
            n = np.fromiter(map(counter.text, b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(tally, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return count(common.documents(spark, sf_dir), read(path, own_method=True))
