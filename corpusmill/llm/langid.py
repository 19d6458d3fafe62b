"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability for each language, learned by expectation maximisation from
word counts.  A word's likelihood is the sum over *all* its segmentations into pieces (forward algorithm); a text's is the
product over its words, so each distinct word is summed once and cached.

The model is fitted on a bounded sample: about ``SAMPLE_DOCS`` documents for each language, chosen by a hash of doc_id, and
fewer where they have over ``SAMPLE_CHARS`` characters.  All words of the sample and every language are learned; the model's size is vocabulary x languages, in
32 bits beyond ``WIDE`` languages.

Defined results: null texts and texts without a letter give ``und`` with score 0; so does every text when nothing could
be learned.  Rows with a null doc_id are predicted but never learned from (held_out false).  Equal scores go to the
language that sorts first.  Each row is predicted by its own text only; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 8_000_000
#: Cells of the lattices that are worked on at once.
_CELLS = 2_000_000
#: Languages up to which tables are 64 bits wide and working sizes fixed; beyond, those shrink as the languages grow.
WIDE = 64
#: Letters of a run that are learned from at once.
RUN = 24
EM_ROUNDS = 4
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_START = "▁"
_FLOOR = 1e-7
_CACHED_WORDS = 250_000
_DOCS_AT_ONCE = 512


def load_pieces(path: str | None = None) -> dict[str, int]:
    """Lower-cased pieces of the vocabulary and their numbers."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            pieces.setdefault(sp.id_to_piece(i).lower(), len(pieces))
    return pieces


class PieceModel:
    """Piece probabilities by language: ``logits`` is (pieces + 1) x languages, its last row for unknown characters."""

    def __init__(self, pieces: dict[str, int], languages: list[str], probabilities: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, probabilities
        self.longest = max(map(len, pieces), default=1)
        # each piece's number, and -1 for what only begins one
        self.starts = {p[:i]: -1 for p in pieces for i in range(1, len(p))} | pieces

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers [word, end, length-1] for words of equal length; -1 where there is no piece."""
        n, unknown, get = len(words[0]), len(self.pieces), self.starts.get
        k = min(n, self.longest)
        out = np.full((len(words), n + 1, k), -1, dtype=np.int32)
        at, pieces, row = [], [], (n + 1) * k
        for base, w in zip(range(0, len(words) * row, row), words):
            for start in range(n):
                cell = base + (start + 1) * k
                single = get(w[start])
                at.append(cell)
                pieces.append(unknown if single is None or single < 0 else single)
                if single is None:
                    continue
                for stop in range(start + 2, min(n, start + k) + 1):
                    cell += k + 1
                    piece = get(w[start:stop])
                    if piece is None:
                        break
                    if piece >= 0:
                        at.append(cell)
                        pieces.append(piece)
        out.reshape(-1)[at] = pieces
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word in each language, summed over all segmentations."""
        out = np.empty((len(words), len(self.languages)))
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w) + 1].append(i)
        for n, members in by_length.items():
            step = max(1, 100_000 * WIDE // (n * max(WIDE, len(self.languages))))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                out[part] = self._forward(self.lattice([_START + words[i] for i in part]))
        return out

    def _forward(self, cells: np.ndarray) -> np.ndarray:
        words, ends, k = cells.shape
        forward = np.zeros((ends, words, len(self.languages)))
        forward[0] = 1.0
        total = np.zeros(forward.shape[1:])
        for end in range(1, ends):
            now = forward[end]
            for size in range(1, min(end, k) + 1):
                piece = cells[:, end, size - 1]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    now[hit] += forward[end - size, hit] * self.p[piece[hit]]
            if end % 16 == 0:  # before the products vanish: all later values become relative to this one
                total += np.log(now)
                forward[max(0, end - k) : end] /= now
                now[:] = 1.0
        return total + np.log(forward[-1])

    def posterior(self, loglik: np.ndarray) -> np.ndarray:
        w = np.exp(loglik - loglik.max())
        return w / w.sum()


def _expectations(cells: np.ndarray, counts: np.ndarray, p: np.ndarray, out: np.ndarray) -> None:
    words, ends, k = cells.shape
    probs = np.where(cells >= 0, p[cells], 0.0)
    a, b = np.zeros((words, ends)), np.zeros((words, ends))
    a[:, 0] = b[:, -1] = 1.0
    for e in range(1, ends):
        for s in range(1, min(e, k) + 1):
            a[:, e] += a[:, e - s] * probs[:, e, s - 1]
    for e in range(ends - 1, 0, -1):
        for s in range(1, min(e, k) + 1):
            b[:, e - s] += b[:, e] * probs[:, e, s - 1]
    z = counts / np.maximum(a[:, -1], 1e-300)
    for e in range(1, ends):
        for s in range(1, min(e, k) + 1):
            hit = cells[:, e, s - 1] >= 0
            share = a[:, e - s] * probs[:, e, s - 1] * b[:, e] * z
            np.add.at(out, cells[hit, e, s - 1], share[hit])


def _fit_one(word_counts: dict[str, int], helper: PieceModel) -> np.ndarray:
    """Piece probabilities of one language by EM from {word: count}; longer runs of letters are cut every ``RUN``."""
    parts: dict[str, int] = defaultdict(int)
    for w, c in word_counts.items():
        for at in range(0, len(w), RUN):
            parts[w[at : at + RUN] if at else _START + w[:RUN]] += c
    by_length = defaultdict(list)
    for w, c in parts.items():
        by_length[len(w)].append((w, c))
    groups = []
    for n, g in sorted(by_length.items()):
        step = max(1, _CELLS // ((n + 1) * min(n, helper.longest)))
        for some in (g[at : at + step] for at in range(0, len(g), step)):
            groups.append((helper.lattice([w for w, _ in some]), np.array([c for _, c in some], dtype=float)))
    n = len(helper.pieces) + 1
    p = np.full(n, 1e-3)
    for _ in range(EM_ROUNDS):
        expected = np.zeros(n)
        for cells, counts in groups:
            _expectations(cells, counts, p, expected)
        p = expected / max(expected.sum(), 1e-300) + _FLOOR
    p[-1] = _FLOOR
    return p


def fit(word_counts, pieces: dict[str, int]) -> PieceModel:
    """EM from (language, {word: count}) pairs, of which one is held at a time, or a dict of them."""
    helper = PieceModel(pieces, [], np.empty((0, 0)))
    columns: dict[str, np.ndarray] = {}
    for lang, words in word_counts.items() if isinstance(word_counts, dict) else word_counts:
        columns[lang] = _fit_one(words, helper)
        if len(columns) > WIDE:
            columns = {k: v.astype(np.float32, copy=False) for k, v in columns.items()}
    languages = sorted(columns)
    table = np.empty((len(pieces) + 1, len(languages)), dtype=np.float64 if len(languages) <= WIDE else np.float32)
    for k, lang in enumerate(languages):
        table[:, k] = columns.pop(lang)
    return PieceModel(pieces, languages, table)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, pieces: dict[str, int] | None = None) -> PieceModel:
    """Learn from rows that are not held out; only their text and non-null lang are used."""
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars")).orderBy("lang").collect()
    pieces = pieces or load_pieces()
    if not sizes:
        return fit({}, pieces)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / r["n"], sample_chars / max(r["chars"], 1))) for r in sizes], "lang string, share double")
    u = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(F.broadcast(shares), "lang").where(u < F.col("share"))
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w != ''")
    counts = words.groupBy("lang", "w").count().persist()

    def by_language():
        for r in sizes:
            rows = counts.where(F.col("lang") == r["lang"]).select("w", "count").collect()
            if rows:
                yield r["lang"], {x["w"]: x["count"] for x in sorted(rows)}

    model = fit(by_language(), pieces)
    counts.unpersist()
    return model


def predictor(model: PieceModel):
    """Function of a list of texts giving [(language, score)]."""
    places: dict[str, int] = {}
    known = np.empty((0, len(model.languages)))

    def run(texts):
        nonlocal places, known
        found = [_WORD.findall(t.lower()) if t else [] for t in texts]
        if len(places) > _CACHED_WORDS * WIDE // max(WIDE, len(model.languages)):
            places, known = {}, known[:0]
        new = list({w for words in found for w in words}.difference(places))
        if new and model.languages:
            places.update((w, len(known) + i) for i, w in enumerate(new))
            known = np.vstack([known, model.score(new)])
        out = []
        for words in found:
            if not model.languages or not any(c.isalpha() for w in words for c in w):
                out.append((UNDETERMINED, 0.0))
                continue
            p = model.posterior(known[[places[w] for w in words]].sum(axis=0))
            best = int(p.argmax())
            out.append((model.languages[best], float(p[best])))
        return out

    return run


def _predict(shared, keep: list[str]):
    def run(batches):
        predict = predictor(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_AT_ONCE):
                part = batch.slice(at, _DOCS_AT_ONCE)
                got = predict(part.column("text").to_pylist())
                new = [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: PieceModel | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score, a row for each row."""
    keep = ["doc_id"] if keep is None else keep
    model = model or train(docs)
    run = _predict(docs.sparkSession.sparkContext.broadcast(model), keep)
    need = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in need.select(*keep).schema)
    return need.mapInArrow(run, f"{schema}, lang_pred string, score double")
