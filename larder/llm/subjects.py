"""Subject areas of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import values as V
from larder.llm.words import HashIds, encode, gram_keys, repair, slices, words
from larder.session import Scratch, ship_package

SHARE = 0.2
#: labelled rows the lexicon and the lifts of sources are fitted on, at most
LABEL_SAMPLE = 20_000
_SIZES = (1, 2, 3)
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>\"']+|[\w.+-]+@[\w.-]+\w")
#: the labelling functions and the number of answers each may give
_LEVELS = {"lexicon": 5, "evidence": 3, "section": 4, "address": 2, "source": 3}


def subject_name(subject: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", subject.lower()).strip("_")


class Sentences:
    """The sentences of a slice of texts as arrays; those of fewer than three words do not count.

    ids: word numbers, -1 between sentences; sentence: its number for each place; doc_of
    and real for each sentence; total: counting sentences of each text.
    """

    def __init__(self, texts: list[str | None], ids: HashIds):
        self.n_docs = len(texts)
        self.ids, doc = encode((repair(t or "") for t in texts), ids, sentences=True, gap=3)
        stop = self.ids == -1
        self.sentence = np.cumsum(stop)
        self.n = int(self.sentence[-1]) + 1 if len(self.ids) else 1
        self.doc_of = np.zeros(self.n, dtype=np.int64)
        self.doc_of[self.sentence[~stop]] = doc[~stop]
        self.real = np.bincount(self.sentence[~stop], minlength=self.n) >= 3
        self.total = np.bincount(self.doc_of[self.real], minlength=self.n_docs)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, sentence) of every run of one to three words in counting sentences, each run once a sentence."""
        keys, at = [], []
        for n in _SIZES:
            key = gram_keys(self.ids, n)
            place = np.flatnonzero(key)
            place = place[self.real[self.sentence[place]]]
            keys.append(key[place] ^ np.uint64(n * 7919))
            at.append(self.sentence[place])
        key, at = np.concatenate(keys).view(np.int64), np.concatenate(at)
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        first = np.ones(len(key), dtype=bool)
        first[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
        return key[first], at[first]


@dataclass
class Lexicon:
    """Runs of words that speak for a subject: sorted keys, the subject and the weight (log-odds) of each."""

    keys: np.ndarray
    owner: np.ndarray
    weight: np.ndarray

    def scores(self, s: Sentences, n_subjects: int) -> np.ndarray:
        """The summed weight of each sentence for each subject."""
        out = np.zeros((s.n, n_subjects))
        if len(self.keys):
            key, at = s.runs()
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[slot] == key
            np.add.at(out, (at[ok], self.owner[slot[ok]]), self.weight[slot[ok]])
        return out

    def of_words(self, found: list[str]) -> set[int]:
        """Subjects that own one of the words."""
        if not found or not len(self.keys):
            return set()
        key = np.array(list(map(HashIds().__missing__, found)), dtype=np.int64)
        key = (gram_keys(key, 1) ^ np.uint64(_SIZES[0] * 7919)).view(np.int64)
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return set(self.owner[slot[self.keys[slot] == key]].tolist())


def log_odds(hit: np.ndarray, all_: np.ndarray, size: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, the same over its standard deviation) of runs met ``hit`` times among the ``size`` units of a subject and ``all_`` times among the whole, half a unit added everywhere."""
    inside, outside = hit + 0.5, all_ - hit + 0.5
    delta = np.log(inside / np.maximum(size + 1 - inside, 0.5)) - np.log(outside / np.maximum(whole - size + 1 - outside, 0.5))
    return delta, delta / np.sqrt(1 / inside + 1 / outside)


def labelled_sample(documents: DataFrame, labels: DataFrame, names: list[str], *, sample: int = LABEL_SAMPLE) -> DataFrame:
    """(doc_id, text, source, mask): labelled documents, bit k of mask for the subject names[k].

    Fitted on at most ``sample`` labelled rows, those with the least hash of doc_id.
    """
    spark = documents.sparkSession
    bits = spark.createDataFrame([(subject_name(s), 1 << k) for k, s in enumerate(names)], "name string, bit bigint")
    rows = labels.select(F.col("doc_id").alias("_id"), V.read_name("subject").alias("name")).where("_id is not null").join(F.broadcast(bits), "name").distinct()
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "name").limit(sample).groupBy("_id").agg(F.bit_or("bit").alias("mask"))
    return documents.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "source", "mask")  # at most ``sample`` rows


class SubjectLexicon:
    """Learns the lexicon: which runs of one to three words speak for which subject.

    Over the labelled documents each run is counted by label; candidates are the runs in
    at least ``least`` documents whose weighted log-odds for their best subject is
    ``least_z`` deviations above nothing and of whose documents a part of at least
    ``guard`` has the label.  Their sentences are then given to the subject with the
    greatest summed log-odds (labels of the document count in full, others by half), or
    to none, and the candidates are weighed again over these sentences: a run speaks for
    a subject if at least ``purity`` of its sentences do.  The words of the name and
    description of a subject are seeds: they speak for it where the sample says nothing
    of them.
    """

    def __init__(self, subjects: list[tuple[str, str]], *, least: int = 2, least_z: float = 2.0, guard: float = 0.45, purity: float = 0.75, enough: float = 2.0, cap: float = 5.0):
        if len(subjects) > 62:
            raise ValueError("at most 62 subjects")
        self.subjects, self.least, self.least_z, self.guard, self.purity, self.enough, self.cap = subjects, least, least_z, guard, purity, enough, cap
        self.k = len(subjects)

    def seeds(self) -> dict[int, int]:
        """Key of a word -> the one subject whose name or description has it."""
        ids, owners = HashIds(), {}
        for k, (subject, description) in enumerate(self.subjects):
            for w in set(words(f"{subject} {description or ''}")):
                if len(w) > 3:
                    key = int((gram_keys(np.array([ids[w]], dtype=np.int64), 1) ^ np.uint64(_SIZES[0] * 7919)).view(np.int64)[0])
                    owners.setdefault(key, set()).add(k)
        return {key: next(iter(k)) for key, k in owners.items() if len(k) == 1}

    def fit(self, sample: DataFrame) -> Lexicon:
        """sample: text, mask.  Candidates are collected: as many as runs of words that come in two of the labelled documents."""
        spark = sample.sparkSession
        ship_package(spark)
        per_label = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(self.k)]
        by_label = sample.groupBy("mask").agg(F.count("*").alias("n"))
        size = by_label.agg(F.sum("n").alias("n"), *per_label).first()  # one row
        sizes, whole = np.array([size[f"c{k}"] or 0 for k in range(self.k)], dtype=float), float(size["n"] or 0)
        seeds = self.seeds()

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = HashIds()
            for whole_batch, part in ((b, s) for b in batches for s in slices(b["text"].tolist())):
                batch = whole_batch.iloc[part]
                s = Sentences(batch["text"].tolist(), ids)
                key, at = s.runs()
                d = pd.DataFrame({"key": key, "doc": s.doc_of[at]}).drop_duplicates()
                d["mask"] = batch["mask"].to_numpy()[d["doc"].to_numpy()]
                yield d.groupby(["key", "mask"], as_index=False).size().rename(columns={"size": "n"})

        runs = sample.select("text", "mask").mapInPandas(count, "key bigint, mask bigint, n bigint")
        runs = runs.groupBy("key").agg(F.sum("n").alias("n"), *per_label)
        likely = F.greatest(*per_label_names(self.k)) >= self.guard * F.col("n")
        runs = runs.where((F.col("n") >= self.least) & (likely | F.col("key").isin(*seeds)))
        got = runs.toPandas().sort_values("key", ignore_index=True)
        keys, n = got["key"].to_numpy(np.int64), got["n"].to_numpy(float)
        c = got[per_label_names(self.k)].to_numpy(float).reshape(-1, self.k)
        delta, z = log_odds(c, n[:, None], sizes[None], whole)
        at = np.arange(len(keys))
        best = z.argmax(axis=1) if len(keys) else np.zeros(0, dtype=np.int64)
        ok = (z[at, best] >= self.least_z) & (c[at, best] >= self.guard * n)
        first = Lexicon(keys, best, np.where(ok, delta[at, best], 0.0))
        known, k_all, enough = spark.sparkContext.broadcast(first), self.k, self.enough  # labelled sample only

        def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, ids = known.value, HashIds()
            met = np.zeros((len(own.keys) + 1, k_all + 1), dtype=np.int64)
            for whole_batch, part in ((b, s) for b in batches for s in slices(b["text"].tolist())):
                batch = whole_batch.iloc[part]
                s = Sentences(batch["text"].tolist(), ids)
                has = (batch["mask"].to_numpy()[:, None] >> np.arange(k_all)) & 1
                score = own.scores(s, k_all) * np.where(has[s.doc_of] > 0, 1.0, 0.5)
                given = np.where(score.max(axis=1, initial=0) >= enough, score.argmax(axis=1) if k_all else 0, k_all)
                met[-1] += np.bincount(given[s.real], minlength=k_all + 1)
                key, at = s.runs()
                if len(own.keys):
                    slot = np.minimum(np.searchsorted(own.keys, key), len(own.keys) - 1)
                    hit = own.keys[slot] == key
                    np.add.at(met, (slot[hit], given[at[hit]]), 1)
            row, subject = np.nonzero(met)
            yield pd.DataFrame({"row": row, "subject": subject, "n": met[row, subject]})

        # rows: candidates and, last, the sentences themselves
        table = sample.select("text", "mask").mapInPandas(weigh, "row bigint, subject bigint, n bigint").groupBy("row", "subject").agg(F.sum("n").alias("n")).toPandas()
        c2 = np.zeros((len(keys) + 1, k_all + 1))
        c2[table["row"].to_numpy(np.int64), table["subject"].to_numpy(np.int64)] = table["n"].to_numpy(float)
        given, c2 = c2[-1], c2[:-1]
        n2 = c2.sum(axis=1)
        best = c2.argmax(axis=1) if len(keys) else best
        ok = best < k_all
        best = np.where(ok, best, 0)
        delta, z = log_odds(c2[at, best], n2, given[best], given.sum())
        ok &= (n2 >= self.least) & (z >= self.least_z) & (c2[at, best] >= self.purity * n2) & (c[at, best] >= self.guard * n)
        learnt = dict(zip(keys[ok].tolist(), zip(best[ok].tolist(), np.minimum(delta[ok], self.cap).tolist())))
        silent = set(keys.tolist())
        for key, k in seeds.items():
            if key not in silent:
                learnt[key] = (k, self.cap)
        keys = np.array(sorted(learnt), dtype=np.int64)
        return Lexicon(keys, np.array([learnt[k][0] for k in keys.tolist()], dtype=np.int64), np.array([learnt[k][1] for k in keys.tolist()]))


def per_label_names(k: int) -> list[str]:
    # greatest() wants two columns or more
    return [f"c{j}" for j in range(k)] if k > 1 else [f"c{j}" for j in range(k)] * 2


def subject_counts(documents: DataFrame, lexicon: Lexicon, n_subjects: int, *, enough: float = 3.0) -> DataFrame:
    """(doc_id, source, total, hits, strong, sections, address), the last four arrays by subject.

    A sentence deals with the subject of the greatest summed log-odds if that is at least
    ``enough``.  hits: its sentences; strong: those with twice as much; sections: thirds
    of the text with one.  A null text counts as empty, rows without a doc_id are left out.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)  # learnt from the labelled sample only

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ids, k = shared.value, HashIds(), n_subjects
        for whole, part in ((b, s) for b in batches for s in slices(b["text"].tolist())):
            batch = whole.iloc[part]
            texts = batch["text"].tolist()
            s = Sentences(texts, ids)
            score = own.scores(s, k)
            best = score.max(axis=1, initial=0)
            deals = np.flatnonzero(s.real & (best >= enough))
            subject = score[deals].argmax(axis=1) if k else deals
            doc = s.doc_of[deals]
            rank = np.cumsum(s.real) - 1
            first = np.full(s.n_docs, s.n, dtype=np.int64)
            np.minimum.at(first, s.doc_of[s.real], rank[s.real])
            third = ((rank[deals] - first[doc]) * 3) // np.maximum(1, s.total[doc])

            def by_doc(rows: np.ndarray | slice) -> np.ndarray:
                out = np.zeros((s.n_docs, k), dtype=np.int64)
                np.add.at(out, (doc[rows], subject[rows]), 1)
                return out

            sections = sum((by_doc(third == t) > 0).astype(np.int64) for t in range(3))
            named = [own.of_words([w for a in _ADDRESS.findall(t) for w in words(a)]) if t and ("@" in t or "://" in t or "www." in t) else () for t in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(), "source": batch["source"].to_numpy(), "total": s.total, "hits": list(by_doc(slice(None))),
                "strong": list(by_doc(best[deals] >= 2 * enough)), "sections": list(sections), "address": [np.array([int(j in n) for j in range(k)], dtype=np.int64) for n in named],
            })

    fields = ", ".join(f"{c} array<bigint>" for c in ("hits", "strong", "sections", "address"))
    return documents.where("doc_id is not null").select("doc_id", "text", "source").mapInPandas(count, f"doc_id bigint, source string, total bigint, {fields}")


def source_lift(sample: DataFrame, n_subjects: int, *, prior: float = 20.0) -> DataFrame:
    """(source, subject, level): 1 where labelled documents of the source have the subject 1.5 times as often as all, 2 where half as often, else no row.

    Shares of a source are drawn to the share of all as by ``prior`` further documents,
    so a source with few labelled documents says little.
    """
    rows = sample.select(V.read_name("source").alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("subject"), F.col("mask").bitwiseAND(F.lit(1 << k)).cast("boolean").alias("has")) for k in range(n_subjects)])).alias("x")).select("source", "x.*")
    by = rows.where("source is not null").groupBy("source", "subject").agg(F.count("*").alias("n"), F.count_if("has").alias("c"))
    base = rows.groupBy("subject").agg(F.avg(F.col("has").cast("double")).alias("share"))
    lift = F.try_divide(F.col("c") + prior * F.col("share"), (F.col("n") + prior) * F.col("share"))
    level = F.when(lift >= 1.5, 1).when(lift <= 0.5, 2).otherwise(0)
    return by.join(F.broadcast(base), "subject").select("source", "subject", level.alias("level")).where("level > 0")  # one row a subject


def learn_accuracies(patterns: pd.DataFrame, *, rounds: int = 50) -> np.ndarray:
    """The posterior of each pattern of answers, by expectation maximisation.

    patterns: ``subject``, one column for each labelling function, ``n``.  Each function
    has its own table of answers given yes and given no, shared by the subjects; each
    subject its own prior.  A function other than the lexicon abstains with 0, which says
    nothing.  Begun from the lexicon's shares.
    """
    n = patterns["n"].to_numpy(dtype=float)
    subject = patterns["subject"].to_numpy(dtype=np.int64)
    yes = np.where(patterns["lexicon"].to_numpy() >= 3, 0.9, 0.01)
    for _ in range(rounds):
        k = int(subject.max()) + 1 if len(subject) else 1
        prior = (np.bincount(subject, n * yes, k) + 1) / (np.bincount(subject, n, k) + 2)
        log_yes, log_no = np.log(prior)[subject], np.log1p(-prior)[subject]
        for name, levels in _LEVELS.items():
            answer = patterns[name].to_numpy(dtype=np.int64)
            for sign, weight in ((1, n * yes), (0, n * (1 - yes))):
                table = np.bincount(answer, weight, levels) + 0.5
                if name != "lexicon":
                    table[0] = 0.0
                part = np.where((answer == 0) & (name != "lexicon"), 0.0, np.log(np.maximum(table, 1e-300) / table.sum())[answer])
                if sign:
                    log_yes = log_yes + part
                else:
                    log_no = log_no + part
        new = 1 / (1 + np.exp(np.clip(log_no - log_yes, -500, 500)))
        if np.abs(new - yes).max(initial=0) < 1e-6:
            return new
        yes = new
    return yes


class SubjectModel:
    """Subjects of documents from labelling functions whose accuracies are learnt.

    For each document and subject the functions answer from different evidence: the
    share of sentences that deal with it by the learnt lexicon; how strong the evidence
    of those sentences is; where they lie (a lone one beside a greater subject, one third
    of the text, several); addresses in the text that name it; and the source.  Answers
    are counted over all documents by pattern (at most some thousands), the latent model
    is fitted to the counts, and each document takes the posterior of its pattern.
    """

    def __init__(self, documents: DataFrame, subjects: DataFrame, labels: DataFrame, *, label_sample: int = LABEL_SAMPLE):
        spark = documents.sparkSession
        scratch = Scratch(spark, "subjects")
        # the list of subjects, one short row each
        listed = sorted({(r["subject"], r["description"] or "") for r in subjects.where("subject is not null").collect()})
        self.names = [s for s, _ in listed]
        k = len(self.names)
        if not k:
            self.posteriors = documents.select("doc_id", F.lit(0).alias("subject"), *[F.lit(0).cast("bigint").alias(c) for c in ("total", "hits")], F.lit(0.0).alias("posterior")).limit(0)
            return
        sample = scratch.keep(labelled_sample(documents, labels, self.names, sample=label_sample), "sample")
        self.lexicon = SubjectLexicon(listed).fit(sample)
        counts = scratch.keep(subject_counts(documents, self.lexicon, k), "counts")
        each = counts.select("doc_id", V.read_name("source").alias("source"), "total", F.array_max("hits").alias("most"), F.posexplode(F.arrays_zip("hits", "strong", "sections", "address")).alias("subject", "c"))
        lift = scratch.keep(source_lift(sample, k), "lift")
        each = each.select("doc_id", "source", "total", "most", "subject", "c.*").join(F.broadcast(lift), ["source", "subject"], "left")  # at most label_sample * subjects rows
        share = F.coalesce(F.try_divide("hits", "total"), F.lit(0.0))
        answers = each.select(
            "doc_id", "total", "hits", "subject",
            F.when(F.col("hits") == 0, 0).when(share < SHARE / 2, 1).when(share < SHARE, 2).when(share < 1.5 * SHARE, 3).otherwise(4).alias("lexicon"),
            F.when(F.col("hits") == 0, 0).when(2 * F.col("strong") < F.col("hits"), 1).otherwise(2).alias("evidence"),
            F.when(F.col("hits") == 0, 0).when((F.col("hits") == 1) & (F.col("most") > 1), 1).when(F.col("sections") == 1, 2).otherwise(3).alias("section"),
            F.col("address").cast("int").alias("address"), F.coalesce("level", F.lit(0)).alias("source"),
        )
        keys = ["subject", *_LEVELS]
        patterns = answers.groupBy(*keys).agg(F.count("*").alias("n")).toPandas()  # subjects * answers at most
        patterns = patterns.sort_values(keys, ignore_index=True)
        patterns["posterior"] = learn_accuracies(patterns)
        self.patterns = patterns
        learnt = spark.createDataFrame([tuple(map(int, r[:-1])) + (float(r[-1]),) for r in patterns[[*keys, "posterior"]].itertuples(index=False)], ", ".join(f"{k} int" for k in keys) + ", posterior double")
        self.posteriors = answers.join(F.broadcast(learnt), keys)  # at most subjects * answers rows

    def _name(self) -> Column:
        return F.element_at(F.array(*map(F.lit, self.names or [None])), F.col("subject") + 1).cast("string")

    def found(self, *, threshold: float = 0.5, share: float = SHARE) -> DataFrame:
        """(doc_id, subject): posterior of at least ``threshold``, and at least ``share`` of the sentences.

        The posterior decides what is a passing mention; empty texts have no subject.
        """
        p = self.posteriors.where((F.col("hits") > 0) & (F.col("hits") >= F.lit(share) * F.col("total")))
        return p.where(F.col("posterior") >= threshold).select("doc_id", self._name().alias("subject"))

    def makeup(self, *, share: float = SHARE) -> DataFrame:
        """(subject, documents, document_share, expected_documents, sentences): the corpus by subject."""
        found = self.found(share=share).groupBy("subject").agg(F.count("*").alias("documents"))
        mass = self.posteriors.groupBy("subject").agg(F.sum("posterior").alias("expected"), F.sum("hits").alias("sentences"), F.count("*").alias("_all"))
        mass = mass.select(self._name().alias("subject"), "expected", "sentences", "_all")
        return mass.join(found, "subject", "left").na.fill(0, ["documents"]).select(
            "subject", "documents", F.try_divide("documents", "_all").alias("document_share"), F.round("expected", 3).alias("expected_documents"), "sentences")


def label_agreement(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, labelled, agreed): labels of the sample and how many of them were found; labels are read as names."""
    rows = labels.select("doc_id", V.read_name("subject").alias("subject")).where("subject is not null").distinct()
    got = found.select("doc_id", V.read_name("subject").alias("subject"), F.lit(1).alias("hit"))
    return rows.join(got, ["doc_id", "subject"], "left").groupBy("subject").agg(F.count("*").alias("labelled"), F.count("hit").alias("agreed"))


def held_out_agreement(documents: DataFrame, subjects: DataFrame, labels: DataFrame, *, parts: int = 5) -> DataFrame:
    """(subject, labelled, agreed): as ``label_agreement``, for one in ``parts`` labelled documents that the model was not fitted on."""
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(parts)) == 0
    model = SubjectModel(documents, subjects, labels.where(~held))
    return label_agreement(model.found(), labels.where(held))
