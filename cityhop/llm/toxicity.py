"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

Voters say toxic (1), clean (-1) or nothing (0) of a text: word lists of insults in four languages, patterns (an insult said to
somebody, a masked insult, many in few words), words and word beginnings that the annotated rows single out, the absence of all of
these, and the annotation itself.

Every document votes.  One pass makes its votes a pattern; patterns are counted in Spark, and the label model estimates by expectation
maximisation over these counts how often each voter says what of toxic and of clean texts.  From what the posterior leaves unexplained
follows which voters are correlated; a voter's evidence is divided by its design effect (one plus its correlations with the others), so
that ten copies of one voter count about once.  Each round is one job over the pattern table, whose sums of whole numbers (posteriors
count in parts of 2^-20) come out alike in any order; the driver holds a number per voter and vote, and one per pair of voters.

A logistic regression on the posterior labels then scores texts: its inputs are counts of the singled-out words and beginnings and of the
insults, as logarithms and per word.  It is fitted on at most ``sample_rows`` annotated rows (by hash of the id; documented bound) with
the posteriors of the corpus-wide label model, and is a table of at most ``vocabulary`` weights; scoring reads whole texts of all rows and
is one pass without a shuffle.  Language, source, id and annotation are never inputs of a score.

Null and empty texts have no words: they get the score of a text without evidence.  Annotations that contradict each other count as
toxic; null annotations as none; without annotations the voters that need none decide.  Repeated rows are scored alike; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityhop.llm.scratch import written
from cityhop.llm.words import batch_shingles, mix

#: Common insults, as words in lower case (fixed values).
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown filthy imbecile bastard vermin jerk",
    "de": "idiot idioten dumm dummkopf trottel arschloch abschaum versager widerlich wertlos penner vollidiot",
    "fr": "idiot idiote imbécile crétin abruti connard salaud ordure minable dégoûtant débile",
    "es": "idiota imbécil estúpido estúpida basura escoria patético asqueroso inútil cabrón",
}
_WORD = re.compile(r"[^\W\d_]+")
_ADDRESSED = re.compile(
    r"\b(?:you(?: are|'re)?|du bist|ihr seid|tu es|vous êtes|eres|sois)(?: \w+){0,2} (?:" + "|".join(sorted(set(" ".join(INSULTS.values()).split()))) + r")\b"
)
_MASKED = re.compile(r"\b[^\W\d_]{1,3}[*@#$]{2,}[^\W\d_]{1,3}\b")
BEGINNINGS = range(3, 9)
#: How often an annotation is right, for the label model.
ANCHORED = 0.995
#: Posteriors are counted in parts of one over this.
PARTS = 1 << 20
_LISTED = {w for words in INSULTS.values() for w in words.split()}
_BY_LANGUAGE = [frozenset(v.split()) for v in INSULTS.values()]


def held_out(id_: Column) -> Column:
    """Rows whose annotations are never learnt from."""
    return F.crc32(id_.cast("string").cast("binary")) % 3 == 1


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:n] + "~" for n in BEGINNINGS if len(word) >= n]]


@dataclass
class Model:
    number: dict[str, int] = field(default_factory=dict)  # a feature's place
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    stems: list[str] = field(default_factory=list)  # features that are voters
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def counts(self, words: Counter) -> dict[int, int]:
        """Occurrences by feature place, and of listed insults under -1."""
        out: dict[int, int] = {}
        known = self.known
        for w, c in words.items():
            hit = known.get(w)
            if hit is None:
                if len(known) > 300_000:
                    known.clear()
                hit = tuple(self.number[f] for f in features_of(w) if f in self.number)
                known[w] = hit = (*hit, -1) if w in _LISTED else hit
            for k in hit:
                out[k] = out.get(k, 0) + c
        return out

    def read(self, text: str | None) -> tuple[dict[int, int], Counter, str]:
        low = (text or "").lower()
        words = Counter(_WORD.findall(low))
        return self.counts(words), words, low

    def inputs(self, counts: dict[int, int], words: Counter) -> tuple[list[int], list[float]]:
        place, value = [], []
        n, total, density = len(self.number), words.total(), 0
        for k, c in counts.items():
            if k < 0:
                place += [n, n + 1]
                value += [math.log1p(c), min(3.0, 100.0 * c / total)]
            else:
                place.append(k)
                value.append(math.log1p(c))
                density += c
        if density:
            place.append(n + 2)
            value.append(min(3.0, 20.0 * density / total))
        place.append(n + 3)
        value.append(math.log1p(total) / 5)
        return place, value

    def votes(self, counts: dict[int, int], words: Counter, low: str) -> list[int]:
        insults = counts.get(-1, 0)
        listed = [1 if insults and not v.isdisjoint(words) else 0 for v in _BY_LANGUAGE]
        stems = [1 if self.number[s] in counts else 0 for s in self.stems]
        many = 1 if insults >= 2 or 100 * insults > 2 * words.total() else 0
        stemmed = 1 if sum(counts.get(self.number[s], 0) for s in self.stems) >= 2 else 0
        none = 0 if any(listed) or any(stems) else -1
        nothing = -1 if not counts else 0
        addressed = 1 if insults and _ADDRESSED.search(low) else 0
        masked = 1 if any(c in low for c in "*@#$") and _MASKED.search(low) else 0
        return [*listed, many, addressed, masked, stemmed, none, nothing, *stems]

    def score(self, text: str | None) -> float:
        counts, words, _ = self.read(text)
        z = self.intercept + sum(float(self.weights[k]) * v for k, v in zip(*self.inputs(counts, words)))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _letters(votes: list[int]) -> str:
    """Votes as text: a letter per voter, a for -1, b for 0, c for 1."""
    return "".join("abc"[v + 1] for v in votes)


def _matrix(patterns: pd.Series) -> np.ndarray:
    return np.frombuffer("".join(patterns).encode(), np.uint8).reshape(len(patterns), -1).astype(np.int64) - ord("b")


def _each(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of ``weight`` by voter and vote."""
    return np.stack([weight @ (votes == v) for v in (-1, 0, 1)], axis=1)


@dataclass
class LabelModel:
    """P(vote | class) by voter as [class, voter, vote + 1], design effects and correlations of the voters; the last is the annotation."""

    prior: float
    table: np.ndarray
    effect: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = (np.log(self.table[1]) - np.log(self.table[0])) / self.effect[:, None]
        logit = math.log(self.prior / (1 - self.prior)) + evidence[np.arange(votes.shape[1]), votes + 1].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _first_posterior(votes: np.ndarray) -> np.ndarray:
    """Where the estimation starts: at the annotation, else at what most voters say."""
    said = votes[:, -1]
    return np.where(said == 0, np.where(votes[:, :-1].sum(axis=1) > 0, 0.7, 0.1), 0.05 + 0.9 * (said > 0))


def _summed(tally: DataFrame, of) -> np.ndarray:
    """Sums over all patterns of the whole numbers that ``of`` (votes, counts) makes of a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                part = of(_matrix(pdf["pattern"]), pdf["n"].to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"place": np.arange(len(total)), "total": total})

    rows = tally.mapInPandas(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(len(rows), np.int64)
    for r in rows:
        out[r["place"]] = r["total"]
    return out


def label_model(tally: DataFrame, voters: int, prior: float, rounds: int = 25) -> LabelModel:
    """The model of a table of vote patterns (letters, the annotation's last) with their counts ``n``; it has at least one row.

    The annotation names the classes: the posterior starts from it, and it is taken to be right in ``ANCHORED`` of its
    votes (estimated freely, the toxic class would shrink to what the other voters know).
    """
    fixed = _summed(tally, lambda votes, n: np.concatenate([_each(votes, n).ravel(), ((votes * n[:, None]).T @ votes).ravel()]))
    said, both = fixed[: 3 * voters].reshape(voters, 3), fixed[3 * voters :].reshape(voters, voters)
    rows = int(said[0].sum())
    effect, correlation = np.ones(voters), np.eye(voters)
    model: LabelModel | None = None
    table = np.full((2, voters, 3), 1 / 3)
    signs = np.array([-1.0, 0.0, 1.0])
    for phase in range(2):
        for _ in range(rounds):

            def expected(votes: np.ndarray, n: np.ndarray, model: LabelModel | None = model) -> np.ndarray:
                post = _first_posterior(votes) if model is None else model.posterior(votes)
                toxic = n * np.rint(post * PARTS).astype(np.int64)
                return _each(votes, toxic).ravel()

            toxic = _summed(tally, expected).reshape(voters, 3) / PARTS
            new = np.stack([(w + 0.5) / (w.sum(axis=1, keepdims=True) + 1.5) for w in (np.maximum(said - toxic, 0.0), toxic)])
            new[:, -1] = ((ANCHORED, 0.5, 1 - ANCHORED), (1 - ANCHORED, 0.5, ANCHORED))
            moved = np.abs(new - table).max()
            table = new
            model = LabelModel(prior, table, effect, correlation)
            if moved < (1e-3, 1e-4)[phase]:
                break
        if phase == 0 and rows > 2:
            # what the classes leave unexplained: the covariance inside both, each row counting in each by its posterior
            left = both.astype(float)
            for share in (np.maximum(said - toxic, 0.0), toxic):
                x, size = share @ signs, share[0].sum()
                left -= np.outer(x, x) / max(size, 1e-9)
            left /= rows
            spread = np.sqrt(np.maximum(np.diag(left), 0.0))
            spread[spread < 1e-6] = np.inf
            correlation = np.clip(left / np.outer(spread, spread), -1, 1)
            np.fill_diagonal(correlation, 1.0)
            effect = np.where(np.abs(correlation) > 0.2, np.abs(correlation), 0.0).sum(axis=1)
            effect[-1] = 1.0
            model = LabelModel(prior, table, effect, correlation)
    return model


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, width: int, penalty: float = 1.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels.

    Accelerated gradient steps on columns scaled to unit size; ``penalty`` is that of the scaled weights, over all rows.
    """
    n = len(rows)
    place = np.concatenate([*(p for p, _ in rows), np.full(n, width)])
    value = np.concatenate([*(v for _, v in rows), np.ones(n)])
    row = np.concatenate([np.repeat(np.arange(n), [len(p) for p, _ in rows]), np.arange(n)])
    size = np.sqrt(np.bincount(place, value**2, minlength=width + 1) / n)
    scale = 1 / np.maximum(size, 0.02)
    value = value * scale[place]
    ridge = np.full(width + 1, penalty / n)
    ridge[width] = 0.0

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[place], minlength=n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(place, value * e[row], minlength=width + 1) / n

    v = np.ones(width + 1)
    for _ in range(30):  # the largest curvature
        u = back(times(v))
        top = float(np.linalg.norm(u))
        v = u / max(top, 1e-12)
    rate = 1 / (0.25 * 1.05 * top + penalty / n)
    w, ahead = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(steps):
        e = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30))) - target
        new = ahead - rate * (back(e) + ridge * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    w = w * scale
    return w[:width], float(w[width])


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"]):
            seen: set[str] = set()
            for w in set(_WORD.findall((text or "").lower())):
                seen.update(features_of(w))
            (toxic if label else clean).update(seen)
        # clean counts matter only next to toxic ones; large tables go out early
        if len(clean) > 500_000:
            yield _tally_rows(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _tally_rows(toxic, clean)


def _tally_rows(toxic: Counter, clean: Counter) -> pd.DataFrame:
    names = list(toxic.keys() | clean.keys())
    return pd.DataFrame({"feature": names, "t": [toxic[x] for x in names], "c": [clean[x] for x in names]}).astype({"feature": object, "t": "int64", "c": "int64"})


def _stems(top, n_toxic: int, n_clean: int, limit: int) -> list[str]:
    """Voters: the most telling features that are rare in clean texts, none the beginning of another."""
    out: list[str] = []
    for name, t, c in top:
        base = name.rstrip("~")
        pure = t * max(1, n_clean) > 20 * c * max(1, n_toxic)
        if pure and len(out) < limit and not any(base.startswith(o.rstrip("~")) or o.startswith(base) for o in out):
            out.append(name)
    return out


def _one_of_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values, bounds = batch_shingles(pdf["text"].tolist(), 3)
        low = [(int(s.min()) >> 1, int(mix(s).min()) >> 1) if len(s) else (0, 0) for s in np.split(values, bounds[1:-1])]
        yield pdf.assign(m1=[a for a, _ in low], m2=[b for _, b in low])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 12_000,
    vocabulary: int = 2_000,
    stems: int = 48,
    seed: int = 11,
    annotations_vote: bool = True,
) -> Model:
    """A model from all documents and the annotations that are not held out.

    Without ``annotations_vote`` the annotations only single out words; neither the label model nor the posteriors see them.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = known.count()
    share = min(1.0, sample_rows / max(1, rows))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = docs.join(F.broadcast(drawn), "id").select("id", "text", "toxic")
    # near copies of a text would make all its words telling: of texts with an equal minimum over their shingles, one is used
    marked = written(sample.mapInPandas(_one_of_copies, "id long, text string, toxic int, m1 long, m2 long"))
    for m in ("m1", "m2"):
        first = marked.groupBy(m, "toxic").agg(F.min("id").alias("id")).select("id")
        marked = marked.join(first, "id", "left_semi")
    sample = written(marked.select("text", "toxic").repartition(16))
    n_toxic, n_clean = (int(x or 0) for x in sample.agg(F.sum((F.col("toxic") > 0).cast("int")), F.sum((F.col("toxic") <= 0).cast("int"))).first())

    table = sample.mapInPandas(_tally, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    rate_t, rate_c = (F.col("t") + 0.5) / (n_toxic + 1.0), (F.col("c") + 0.5) / (n_clean + 1.0)
    z = (F.log(rate_t / (1 - rate_t)) - F.log(rate_c / (1 - rate_c))) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    least = max(2, n_toxic // 400)
    top = table.where(F.col("t") >= least).withColumn("z", z).where("z > 2.5").orderBy(F.desc("z"), "feature").limit(vocabulary).collect()
    model = Model(number={r["feature"]: k for k, r in enumerate(top)})
    model.stems = _stems(((r["feature"], r["t"], r["c"]) for r in top), n_toxic, n_clean, stems)

    width = len(model.number) + 4
    if n_toxic + n_clean == 0:
        return Model(weights=np.array([1.5, 1.0, 0.0, -0.3]), intercept=-3.0)
    voters = 11 + len(model.stems)
    prior = min(0.5, max(0.01, n_toxic / (n_toxic + n_clean)))
    labels_of = label_model(written(vote_patterns(docs, known if annotations_vote else known.limit(0), model)), voters, prior)
    parts = sample.mapInPandas(_sampled(model, labels_of, annotations_vote), "place array<int>, value array<double>, posterior double").collect()
    # at most sample_rows short rows, in the same order whichever task came first
    parts.sort(key=lambda r: (len(r["place"]), r["posterior"], r["place"], r["value"]))
    rows = [(np.array(r["place"], np.int64), np.array(r["value"], float)) for r in parts]
    model.weights, model.intercept = logistic(rows, np.array([r["posterior"] for r in parts]), width)
    return model


def vote_patterns(docs: DataFrame, known: DataFrame, model: Model) -> DataFrame:
    """How many of all documents (id, text) have which votes: pattern, n.  Annotations (id, toxic) are the last voter."""

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "pattern": [_letters(model.votes(*model.read(text))) for text in pdf["text"]]})

    # rows without an id meet no annotation; names of their own spread them over the tasks
    named = docs.select(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-null-"), F.monotonically_increasing_id())).alias("id"), "text")
    says = known.select(F.col("id").cast("string").alias("id"), F.when(F.col("toxic") > 0, "c").otherwise("a").alias("says"))
    met = named.mapInPandas(voted, "id string, pattern string").join(says, "id", "left")
    return met.groupBy(F.concat("pattern", F.coalesce("says", F.lit("b"))).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def _sampled(model: Model, labels_of: LabelModel, annotations_vote: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, votes = [], []
            for text, label in zip(pdf["text"], pdf["toxic"]):
                counts, words, low = model.read(text)
                out.append(model.inputs(counts, words))
                votes.append([*model.votes(counts, words, low), (1 if label else -1) if annotations_vote else 0])
            if out:
                yield pd.DataFrame(out, columns=["place", "value"]).assign(posterior=labels_of.posterior(np.array(votes)))

    return run


def _scored(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": np.array([model.score(text) for text in pdf["text"]], float)})

    return run


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, score, predicted."""
    kind = documents.schema[id_col].dataType
    rows = documents.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(_scored(model), "id string, score double")
    return out.select(F.col("id").cast(kind).alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_documents(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, without those that the model rejects."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype=float)

    return documents.where(of(F.col(text_col)) < threshold)
