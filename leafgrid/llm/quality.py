"""Operator 1: weak-label quality classifier.

Overlapping heuristic labellers vote "good", "junk", "toxic" or abstain on every document. Expectation-maximisation over the
counts of all vote patterns of the whole corpus estimates each labeller's accuracy (a table class -> vote) and the class
shares; the posterior labels then train a hashed linear (softmax) scorer, which decides on every document.

Toxicity is a matter of share: a labeller votes for it where a text has two entries of its list or more and they make up TOXIC_SHARE of its words; a
single mention anywhere, or a few in a long text, get no vote. One labeller reads a built-in English list. Where a table of labels is given, another one reads
words, and stems, that labelled toxic documents have and others don't, as far as the evidence can't be chance; a third looks at how many different
entries of both there are. Labellers of function words and word lengths abstain on very short texts and on scripts that these say nothing about.
Source code counts as junk: the classifier is one of prose.

Two passes over the texts: one counts vote patterns (what leaves the executors is one row per distinct pattern, a number
bounded by the labellers' votes, not by the corpus), one scores. The scorer is fitted on a bounded sample of documents
(``train_rows``, rows alike once), the list on a bounded sample of labels (``label_rows``); counts and decisions cover all documents.

Defined cases: a null or empty text has no words, gets p_good 0 and is rejected; a text of any length is read whole; p_good equal to the threshold keeps; a null
doc_id is passed through; repeated rows are decided on alike, of repeated labels of one id the toxic one counts; an empty table gives an
empty result; other columns are not read, ``keep_good`` returns them as they are.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = ("good", "junk", "toxic")
#: Insults, as a labeller's lexicon (English; extend by parameter).
LEXICON = frozenset(
    "idiot idiots moron morons stupid trash scum loser losers clown pathetic worthless disgusting imbecile dumb dumbass "
    "retard bastard bastards bitch bitches asshole assholes fuck fucking fucked shit bullshit slut whore cunt dickhead jerk "
    "vermin filthy freak freaks degenerate subhuman crap".split()
)
#: Frequent function words of the corpus' languages.
FUNCTION = frozenset(
    "the of and to in is that it for as with was on are be this by an not or at from have he she they de la le les et un une des "
    "du en que qui dans pour par sur est au avec der die das und ist von zu den mit ein eine nicht auf für im dem el los las y "
    "una por con para del se al su lo es".split()
)
_CODES = np.arange(256)
SYMBOL = np.isin(_CODES, [ord(c) for c in "%$#&*!|@^~<>{}[]\\=+"])
MARK = np.isin(_CODES, [c for c in range(33, 127) if not chr(c).isalnum() and c != 95])
UPPER = (_CODES >= 65) & (_CODES <= 90)
DIM_BITS = 18
#: The share of entries of a list among a text's words from which it counts as toxic.
TOXIC_SHARE = 0.004
#: For how many documents of each class the expectation of better labellers counts, and what votes (g, j, t, -) are expected of junk beside the usual ones.
PRIOR_ROWS, JUNK_VOTES = 1, np.array([0.2, 0.4, 0.02, 0.38])
#: Scripts other than Latin, and those of them that are written without spaces.
_OTHER = re.compile("[\u0370-\u1fff\u3040-\ud7ff\uf900-\ufdff\ufe70-\ufeff]")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
#: Letters of a word that stand for its stem in a lexicon.
STEM = 5


def features(text: str | None, learned: frozenset = frozenset()) -> dict[str, float] | None:
    """Measures that the labellers and the scorer use; None if there are no words."""
    if not text or not (tokens := text.split()):
        return None
    n = len(tokens)
    foreign = unspaced = 0
    if not text.isascii():
        foreign, unspaced = len(_OTHER.findall(text)), len(_UNSPACED.findall(text))
        n += unspaced // 2
    low = common.WORD.findall(text.lower())
    seen = Counter(low)
    lines = [x for x in text.split("\n") if x.strip()]
    built_in = [seen[w] for w in LEXICON.intersection(seen)]
    found = [c for w, c in seen.items() if w in learned or w[:STEM] + "*" in learned] if learned else []
    top = sorted((c for w, c in seen.items() if c > 2 and w not in FUNCTION), reverse=True)[:3]
    raw = np.frombuffer(text.encode(), np.uint8)
    mark = MARK[raw]
    runs = np.count_nonzero(mark[1:] & mark[:-1]) - np.count_nonzero(mark[2:] & mark[1:-1] & mark[:-2])  # runs of two or more
    letters = sum(map(len, low))
    plain = 2 * foreign < letters and n >= 8  # a few words say nothing about their kind
    return {
        "n": n, "symbol": np.count_nonzero(SYMBOL[raw]) / n, "marks": runs / n, "letters": letters / max(1, len(text) - len(tokens)),
        "caps": sum(map(str.isupper, tokens)) / n, "shout": np.count_nonzero(UPPER[raw]) / len(raw), "run": sum(map(str.__eq__, low, low[1:])) / n,
        "line": 1 - len(set(lines)) / max(1, len(lines)), "pipe": text.count("|") / n, "unique": len(seen) / max(1, len(low)), "top": sum(top) / n,
        "function": sum(seen[w] for w in FUNCTION.intersection(seen)) / n if plain else None, "length": letters / max(1, len(low)) if plain else None,
        "built_in": _share(built_in, n), "learned": _share(found, n), "kinds": len(built_in) + len(found), "both": _share(built_in + found, n), "seen": seen,
    }


def _share(counts: list[int], n: int) -> float | None:
    """The entries' share of the words, None for a single mention."""
    total = sum(counts)
    return None if total == 1 else total / n


def votes(f: dict[str, float] | None) -> str:
    """One letter per labeller: g, j, t or - for abstaining; e alone for a text without words. Several labellers look at each fault."""
    if f is None:
        return "e"
    long = f["n"] > 30
    toxic = lambda share: "-" if share is None or 0 < share < TOXIC_SHARE else "t" if share else "g"
    v = [
        "j" if f["symbol"] > 0.4 else "g" if f["symbol"] < 0.05 else "-",
        "j" if f["marks"] > 0.2 else "g" if f["marks"] < 0.05 else "-",
        "j" if f["letters"] < 0.85 else "-",
        "j" if f["caps"] > 0.4 else "g" if f["caps"] < 0.1 else "-",
        "j" if f["shout"] > 0.3 else "-",
        "j" if f["run"] > 0.15 else "g" if f["run"] < 0.02 else "-",
        "j" if f["line"] > 0.3 else "g" if f["line"] == 0 else "-",
        "j" if f["pipe"] > 0.2 else "-",
        "j" if f["unique"] < 0.2 and long else "g" if f["unique"] > 0.5 else "-",
        "j" if f["top"] > 0.3 and long else "-",
        "-" if f["function"] is None else "g" if f["function"] > 0.1 else "j" if f["function"] < 0.02 and long else "-",
        "-" if f["length"] is None else "j" if f["length"] > 14 or f["length"] < 2 else "-",
        toxic(f["built_in"]),
        toxic(f["learned"]),
        "g" if not f["kinds"] else "t" if f["kinds"] > 1 and f["both"] >= TOXIC_SHARE else "-",
    ]
    return "".join(v)


def em(patterns: list[str], counts: list[int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class shares, accuracies[labeller, class, vote], posterior[pattern, class]) by expectation-maximisation.

    Votes are independent given the class. Labellers are held to be better than chance until the documents say otherwise, so that a few documents with one vote
    for a fault against many others make no class of their own. A pattern belongs only to classes that a labeller voted for, and the start is the
    weighed share of votes for each class, so that classes keep their names; from there on votes have the weight that their labeller's accuracy gives them.
    """
    letters = "gjt-"
    x = np.array([[letters.index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    w = np.asarray(counts, float)
    start = np.stack([(x == k).sum(1) for k in range(3)], 1).astype(float)
    start *= [0.3, 2.0, 6.0]  # a vote for a fault says more than one for its absence
    usual = np.stack([w @ (x == v) for v in range(4)], 1) / max(1, w.sum())
    prior = np.stack([usual * [1, 0.5, 0.1, 1], (usual + JUNK_VOTES) / 2, usual * [1, 1, 10, 1]], 1) + 1e-3
    prior *= PRIOR_ROWS / prior.sum(2, keepdims=True)
    voted = (start > 0) | (start.sum(1, keepdims=True) == 0)
    post = (start + 1e-9) / (start + 1e-9).sum(1, keepdims=True)
    for _ in range(rounds):
        share = (post * w[:, None]).sum(0) + 1
        share /= share.sum()
        table = prior.copy()
        for j in range(x.shape[1]):
            for v in range(4):
                table[j, :, v] += (post[x[:, j] == v] * w[x[:, j] == v, None]).sum(0)
        table /= table.sum(2, keepdims=True)
        log = np.log(share) + sum(np.log(table[j][:, x[:, j]]).T for j in range(x.shape[1]))
        post = np.exp(log - log.max(1, keepdims=True)) * voted + 1e-12 * voted
        post /= post.sum(1, keepdims=True)
    return share, table, post


class _Index(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= common.MEMO_LIMIT:
            self.clear()
        value = self[word] = zlib.crc32(word.encode()) >> (32 - DIM_BITS)
        return value


_index = _Index()


def hashed(f: dict) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices and values: words (weighed down by their number) and the binned measures."""
    seen = f["seen"]
    bins = [
        f"\x00{k}:{'?' if f[k] is None else sum(f[k] > c for c in cuts)}"
        for k, cuts in (("symbol", (0.05, 0.2, 0.5, 1)), ("caps", (0.1, 0.3, 0.5, 0.8)), ("run", (0.02, 0.1, 0.2, 0.5)), ("line", (0, 0.1, 0.3, 0.6)), ("marks", (0.05, 0.2, 0.5)), ("letters", (0.7, 0.85, 0.95)), ("shout", (0.05, 0.1, 0.3)), ("top", (0.1, 0.3, 0.5)), ("pipe", (0.02, 0.1, 0.25)), ("unique", (0.05, 0.15, 0.3)), ("function", (0.02, 0.1, 0.2)), ("length", (2, 4, 8, 14)), ("built_in", (TOXIC_SHARE, 0.01)), ("learned", (TOXIC_SHARE, 0.01)), ("both", (TOXIC_SHARE, 0.01)))
    ]
    index = np.fromiter(map(_index.__getitem__, itertools.chain(seen, bins)), np.int32, len(seen) + len(bins))
    value = np.full(len(index), 0.3 / max(1, len(seen)) ** 0.5, np.float32)
    value[len(seen) :] = 1
    return index, value


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 60, l2: float = 1e-4) -> np.ndarray:
    """Weights [2**DIM_BITS + 1, 3] of a softmax regression on soft labels (Adagrad, full batches); the last row is the bias."""
    weights = np.zeros(((1 << DIM_BITS) + 1, 3), np.float32)
    if not rows:
        return weights
    size = np.array([len(i) + 1 for i, _ in rows])
    index = np.concatenate([np.append(i, 1 << DIM_BITS) for i, _ in rows])
    used, index = np.unique(index, return_inverse=True)
    value = np.concatenate([np.append(v, np.float32(1)) for _, v in rows])[:, None]
    start = np.cumsum(size) - size
    w, square = np.zeros((len(used), 3), np.float32), np.full((len(used), 3), 1e-6, np.float32)
    order = np.argsort(index, kind="stable")
    first = np.searchsorted(index[order], np.arange(len(used)))
    row = np.repeat(np.arange(len(rows)), size)[order]
    ordered = value[order]
    for _ in range(rounds):
        z = np.add.reduceat(w[index] * value, start)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.add.reduceat(((p - target) / len(rows)).astype(np.float32)[row] * ordered, first) + l2 * w
        square += g * g
        w -= 0.3 * g / np.sqrt(square)
    weights[used] = w
    return weights


def probabilities(f: dict | None, weights: np.ndarray) -> np.ndarray:
    if f is None:
        return np.array([0.0, 1.0, 0.0])
    index, value = hashed(f)
    z = value.astype(np.float64) @ weights[index] + weights[-1]
    p = np.exp(z - z.max())
    return p / p.sum()


def derive_lexicon(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_rows: int = 20_000, chance: float = 0.05, precision: float = 0.99) -> frozenset:
    """Words, and stems of STEM letters, that mark labelled toxic documents.

    label_rows bounds the sample of labels (rows alike once). An entry is taken if toxic documents have it, hardly any other does, and among all entries looked at no more
    than ``chance`` are to be expected that have as many toxic documents by luck. A word counts once per family of toxic documents that share
    their smallest hash of three words, so that copies of one text don't make its words look toxic.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    total, toxic = labels.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    if not toxic:
        return frozenset()
    drawn: dict = {}
    for i, y in common.drawn(labels, label_rows, total, 2).collect():
        drawn[i] = max(y, drawn.get(i, 0))
    known = docs.sparkSession.sparkContext.broadcast(drawn)  # label_rows entries

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = []
            for k in (k for k, i in enumerate(ids) if i in known.value):
                text = b.column(1)[k].as_py()
                if len(h := common.word_hashes([text])[0]) and (tokens := common.words(text)):
                    seen = set(tokens) | {w[:STEM] + "*" for w in tokens if len(w) > STEM}
                    out.append((int(known.value[ids[k]]), int(common.ngrams(h, 3).min() >> np.uint64(1)), " ".join(seen)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["toxic", "family", "seen"])

    def tally(table: pa.Table) -> pa.Table:
        found, size = [Counter(), Counter()], [0, 0]
        once = set()
        for y, family, seen in zip(*(table.column(k).to_pylist() for k in ("toxic", "family", "seen"))):
            if not y or family not in once:
                once |= {family} if y else set()
                size[bool(y)] += 1
                found[bool(y)].update(seen.split(" "))
        # all of c documents toxic by luck, for one of the entries at least: entries * share ** c
        least = math.log(max(1, len(found[1])) / chance) / -math.log(max(size[1], 1) / (sum(size) + 1))
        rows = [w for w, c in found[1].items() if c >= least and c / (c + found[0][w]) >= precision and w not in LEXICON]
        return pa.table({"word": pa.array(rows, pa.string())})

    # one group: a sample of label_rows documents
    rows = docs.select(id_col, text_col).mapInArrow(take, "toxic int, family long, seen string").groupBy().applyInArrow(tally, "word string").collect()
    return frozenset(r.word for r in rows)


def fit(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", train_rows: int = 5000) -> tuple[np.ndarray, frozenset]:
    """(weights of the scorer, the learned list). train_rows bounds the sample it is fitted on (rows alike once); all documents' votes are counted."""
    lexicon = derive_lexicon(docs, labels, text_col, id_col) if labels is not None else frozenset()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter(votes(features(t, lexicon)) for t in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select(text_col).mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    total, counted = sum(r.n for r in counted), [r for r in counted if r.pattern != "e"]
    if not counted:
        return train([], np.zeros((0, 3))), lexicon
    _, _, posterior = em([r.pattern for r in counted], [r.n for r in counted])
    label = {r.pattern: p for r, p in zip(counted, posterior)}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(votes(f), *(x.tobytes() for x in hashed(f))) for f in (features(t, lexicon) for t in b.column(0).to_pylist()) if f]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string())] + [pa.array([x[k] for x in out], pa.binary()) for k in (1, 2)], ["pattern", "at", "weight"])

    rows = common.drawn(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text <> ''"), train_rows, total, 1).select("text").mapInArrow(sample, "pattern string, at binary, weight binary").collect()
    rows = sorted((r for r in rows if r.pattern in label), key=lambda r: (r.pattern, r.at))
    return train([(np.frombuffer(r.at, np.int32), np.frombuffer(r.weight, np.float32)) for r in rows], np.array([label[r.pattern] for r in rows]).reshape(-1, 3)), lexicon


def classify(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, train_rows: int = 5000) -> DataFrame:
    """(doc_id, p_good, p_junk, p_toxic, keep) of every row; keep where p_good is at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col, train_rows))  # of a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lexicon = shared.value
        for b in batches:
            p = np.array([probabilities(features(t, lexicon), weights) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 0] >= threshold)], ["doc_id", "p_good", "p_junk", "p_toxic", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"doc_id {kind}, p_good double, p_junk double, p_toxic double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5, train_rows: int = 5000) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text_col, id_col, train_rows))
    at = docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lexicon = shared.value
        for b in batches:
            yield b.filter(pa.array([bool(probabilities(features(t, lexicon), weights)[0] >= threshold) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
