"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language. A word's probability is the sum over all
its segmentations into pieces, found by the forward algorithm; a text's is the product over its words. Probabilities
are estimated by expectation maximisation (forward and backward sums) from word counts of labelled documents.

Words are runs of letters in lower case with the vocabulary's mark of a word's start. Scores are over whole words of any
length: the algorithm keeps only the sums that the longest piece can reach back to, and scales them as it goes. Only for
the estimate are words of over BLOCK letters cut. Many words go through the algorithm at once, as arrays; each worker
keeps the scores of the words it has seen.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, pick, small_batches
from .tokens import vocabulary_path

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Letters of a word, or of a block of a longer one, in the estimate.
BLOCK = 31
#: Documents of each language for the estimate, about.
SAMPLE = 800
#: A table with more languages is an error: the model that workers get grows with them.
LANGUAGES = 2048
STEPS = 3
#: Scores (words times languages) that a worker keeps, then it starts anew; those worked out at once, and letters.
KEPT, AT_ONCE, LETTERS = 2_400_000, 40_000, 400_000
#: Letters between which sums are scaled; a letter no piece covers lessens them most.
SCALED = 8
#: The probability of a letter that no piece covers.
UNKNOWN = 1e-9


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Pieces:
    """The vocabulary's pieces of letters, found by a hash of their code points."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        own = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.names = sorted({p for p in own if p and p == p.lower() and re.fullmatch(f"{MARK}?[^\\W\\d_]*", p)})
        self.longest = max(map(len, self.names))
        hashes = np.array([self._hash(p) for p in self.names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int32)
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("two pieces have one hash")
        self.unknown = len(self.names)

    def _hash(self, piece: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * self.BASE + np.uint64(ord(c) + 1)
        return h

    @staticmethod
    def letters(blocks: list[str], most: int) -> np.ndarray:
        """Code points plus 1, (block, place); 1 beyond a block's end."""
        flat = np.frombuffer("".join(b.ljust(most, "\0") for b in blocks).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(blocks), most)
        return flat.astype(np.uint64) + np.uint64(1)

    def at_starts(self, codes: np.ndarray, lengths: np.ndarray, starts: int) -> Iterator[np.ndarray]:
        """For each piece length from 1, (block, start) of piece ids for the first starts; -1: no piece.

        A single letter that is no piece has the id `unknown`. codes reach as far beyond the starts as pieces do, or to
        the end; lengths count from the first of codes.
        """
        h = np.zeros_like(codes)
        with np.errstate(over="ignore"):
            for length in range(1, min(self.longest, codes.shape[1]) + 1):
                width = min(starts, codes.shape[1] - length + 1)
                h = h[:, : codes.shape[1] - length + 1] * self.BASE + codes[:, length - 1 :]
                own = h[:, :width]
                at = np.searchsorted(self.hashes, own)
                at[at == len(self.hashes)] = 0
                ids = np.where(self.hashes[at] == own, self.ids[at], self.unknown if length == 1 else -1)
                ids[np.arange(width)[None, :] + length > lengths[:, None]] = -1
                yield ids

    def found(self, blocks: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Lengths of blocks, and the piece ids at all starts by piece length."""
        lengths = np.array([len(b) for b in blocks], dtype=np.int64)
        most = int(lengths.max(initial=1))
        return lengths, list(self.at_starts(self.letters(blocks, most), lengths, most))


def log_sums(pieces: Pieces, words: list[str], p: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Logarithms of the sums over all segmentations of whole words: (word, language)."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    most, reach = int(lengths.max(initial=1)), pieces.longest + 1
    codes = pieces.letters(words, most)
    shape = (len(words), p.shape[1])
    ring, scale, out = np.zeros((reach, *shape)), np.zeros(shape), np.zeros(shape)
    ring[0] = 1.0
    for base in range(0, most, columns):
        starts = min(columns, most - base)
        found = list(pieces.at_starts(codes[:, base : base + starts + reach - 2], lengths - base, starts))
        for k in range(starts):
            i = base + k
            now = ring[i % reach].copy()
            ring[i % reach] = 0.0
            for length, ids in enumerate(found, 1):
                if k >= ids.shape[1]:
                    break
                if len(own := np.flatnonzero(ids[:, k] >= 0)):
                    ring[(i + length) % reach, own] += now[own] * p[ids[own, k]]
            ended = np.flatnonzero(lengths == i + 1)
            out[ended] = np.log(np.maximum(ring[(i + 1) % reach, ended], 1e-300)) + scale[ended]
            if i % SCALED == SCALED - 1:
                high = ring.max(axis=0)
                high[high == 0] = 1.0
                ring /= high
                scale += np.log(high)
    return out


def forward(lengths: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of the first j letters: (block, j, language). p: (piece, language), its last row 0."""
    n, most, languages = len(lengths), int(lengths.max(initial=0)), p.shape[1]
    f = np.zeros((n, most + 1, languages))
    f[:, 0] = 1.0
    for j in range(1, most + 1):
        for length in range(1, min(len(found), j) + 1):
            ids = found[length - 1][:, j - length]
            own = np.flatnonzero(ids >= 0)
            f[own, j] += f[own, j - length] * p[ids[own]]
    return f


def backward(lengths: np.ndarray, found: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    n, most, languages = len(lengths), int(lengths.max(initial=0)), p.shape[1]
    b = np.zeros((n, most + 1, languages))
    b[np.arange(n), lengths] = 1.0
    for j in range(most - 1, -1, -1):
        for length in range(1, min(len(found), most - j) + 1):
            ids = found[length - 1][:, j]
            own = np.flatnonzero(ids >= 0)
            b[own, j] += b[own, j + length] * p[ids[own]]
    return b


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    probabilities: np.ndarray  # (piece, language), the last two rows: unknown letters, no piece
    prior: np.ndarray  # logarithms
    #: Names the model wherever it is sent: each task gets a copy of its own.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def blocks_of(word: str) -> list[str]:
    if len(word) <= BLOCK:
        return [MARK + word]
    return [MARK + word[:BLOCK], *[word[i : i + BLOCK] for i in range(BLOCK, len(word), BLOCK)]]


def fit(counts: dict[str, dict[str, int]], prior: dict[str, int], vocabulary: str = "piece_bpe_32k.model", steps: int = STEPS) -> Model:
    """Piece probabilities from counts of words by language."""
    pieces, languages = Pieces(vocabulary), sorted(counts)
    n = len(pieces.names)
    p = np.zeros((n + 2, len(languages)))
    columns = []
    for language in languages:
        blocks: dict[str, int] = {}
        for w, c in counts[language].items():
            for b in blocks_of(w):
                blocks[b] = blocks.get(b, 0) + c
        names = sorted(blocks, key=lambda b: (len(b), b))
        columns.append((names, np.array([blocks[b] for b in names], dtype=np.float64)))
    # First: each piece as probable as it is frequent anywhere in words.
    soft = [_expected(pieces, *c, None, n) for c in columns]
    for _ in range(steps):
        together = sum(x / max(x.sum(), 1.0) for x in soft) / max(1, len(soft)) + 1e-9
        for k, own in enumerate(soft):
            q = own + 20.0 * together / together.sum()  # a little of all languages' pieces, so that none is impossible
            p[:n, k] = q / q.sum()
        p[n], p[n + 1] = UNKNOWN, 0.0
        soft = [_expected(pieces, *c, p[:, k : k + 1], n) for k, c in enumerate(columns)]
    total = sum(prior.values()) + len(languages)
    return Model(vocabulary, languages, p, np.log([(prior.get(x, 0) + 1) / total for x in languages]))


def _expected(pieces: Pieces, names: list[str], counts: np.ndarray, p: np.ndarray | None, n: int) -> np.ndarray:
    """How often each piece is used, over all segmentations of all words."""
    out = np.zeros(n + 2)
    for at in range(0, len(names), 20_000):
        lengths, found = pieces.found(names[at : at + 20_000])
        c = counts[at : at + 20_000]
        if p is None:
            for ids in found:
                out += np.bincount(np.where(ids < 0, n + 1, ids).ravel(), np.repeat(c, ids.shape[1]), n + 2)
            continue
        f, b = forward(lengths, found, p)[:, :, 0], backward(lengths, found, p)[:, :, 0]
        z = np.maximum(b[:, 0], 1e-300)
        for length, ids in enumerate(found, 1):
            width = ids.shape[1]
            use = f[:, :width] * p[ids, 0] * b[:, length : length + width] * (c / z)[:, None]
            out += np.bincount(np.where(ids < 0, n + 1, ids).ravel(), use.ravel(), n + 2)
    return out[:n]


class Scorer:
    """Logarithms of word probabilities, kept for words seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.pieces = model, Pieces(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        new = np.zeros((len(words), len(self.model.languages)))
        step, at = max(1, AT_ONCE // len(self.model.languages)), 0
        while at < len(words):
            to = min(at + step, len(words))
            while to > at + 1 and (to - at) * len(words[to - 1]) > LETTERS:
                to = (at + to) // 2
            new[at:to] = log_sums(self.pieces, [MARK + w for w in words[at:to]], self.model.probabilities)
            at = to
        base = len(self.scores)
        self.at.update((w, base + i) for i, w in enumerate(words))
        self.scores = np.concatenate([self.scores, new.astype(np.float32)])

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its probability) of each text; ("und", 0) without a letter."""
        cut = [words_of(t) for t in texts]
        if self.scores.size > KEPT:
            self.clear()
        new = {w for ws in cut for w in ws if w not in self.at}
        if new:
            self.learn(list(new))
        out, get = [], self.at.__getitem__
        for ws in cut:
            if not any(c.isalpha() for w in ws for c in w):
                out.append(("und", 0.0))
                continue
            total = self.scores[np.fromiter(map(get, ws), np.int64, len(ws))].sum(axis=0, dtype=np.float64) + self.model.prior
            k = int(total.argmax())  # of equal ones the first by name
            out.append((self.model.languages[k], float(1 / np.exp(total - total[k]).sum())))
        return out


def train(docs: DataFrame, sample: int = SAMPLE, vocabulary: str = "piece_bpe_32k.model", held_out=None) -> Model:
    """A model from the text and language of rows with a language that aren't held out.

    About `sample` documents of each language, drawn by a hash of doc_id and text, give the word counts; how many
    documents a language has comes from all of them. All languages are learned; more than LANGUAGES are an error.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("lang IS NOT NULL")
    if held_out is not None:
        rows = rows.where(~held_out)
    counted = rows.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        raise ValueError(f"the table has more than {LANGUAGES} languages")
    prior = {r["lang"]: r["count"] for r in counted}
    if not prior:
        return Model(vocabulary, ["und"], np.zeros((2, 1)), np.zeros(1))
    part = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in prior.items()])
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id", F.coalesce("text", F.lit(""))), F.lit(1_000_000))
    drawn = rows.where(draw < part * 1_000_000)
    words = drawn.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counts: dict[str, dict[str, int]] = {k: {} for k in prior}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        counts[r["lang"]][r["word"]] = r["count"]
    return fit(counts, prior, vocabulary)


_SCORERS: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One for each worker, which Spark uses again for later tasks; of one model at a time."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row: the most probable language and its probability.

    Null texts and those without a letter are `und` with the score 0; if no language was learned, all texts are.
    Repeated rows come out alike. An empty table gives no rows. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded: pieces of the vocabulary times LANGUAGES
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent.value.languages == ["und"]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["und"] * batch.num_rows), pa.array([0.0] * batch.num_rows)], schema=out)
            return
        scorer = scorer_of(sent.value)
        for batch in batches:
            found = scorer.batch(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], schema=out)

    return pick(docs, "doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def held_out():
    return id_crc32(F.col("doc_id")) % 3 == 1
