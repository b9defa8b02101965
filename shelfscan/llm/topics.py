"""Subjects of documents: labelling functions weighed by a latent model that learns their accuracies."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfscan.session import spread, written

#: The seed lexicon is learned on at most so many labelled documents (the first by hash).
LABELLED = 20_000
#: Words a subject has in a lexicon, at most: the most telling first. Bounds what is broadcast.
LEXICON = 4000
#: Share of a word's documents that one subject must have, smoothed; documents it must have.
TELLING, SEEN = 0.7, 3
#: A document teaches the lexicon if one subject has this share of its seed words, and at least TEACH of them.
SURE, TEACH = 0.8, 4
#: Levels of the share-valued functions.
LEVELS = 20
ROUNDS = 30
#: Where the fit begins: below this share of a document's telling words, or of its sentences, a subject is mentioned; above MAIN it is the main one.
MENTIONED, SECTION, MAIN = 0.22, 0.2, 0.78
#: How many documents' worth of independence the joint answer of lexicon and section begins with; the share of all documents that the beginning counts on as a
#: prior of the fit; and the weight of the functions that lean on the lexicon's words (title, address, source), which are less than one voice each.
PRIOR, ANCHOR, VOICE = 10.0, 0.2, 0.5
WORD = re.compile(r"[^\W\d_]{3,}")
SENTENCE = re.compile(r"[^.!?;\n]+")
ADDRESS = re.compile(r"[\w.+-]+@[\w.-]+|https?://\S+|(?:/[\w.-]+){2,}")


def _seed_counts(batches):
    held: dict = {}
    for batch in batches:
        for text, subject in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _count(held, Counter(x.lower() for x in WORD.findall(text)), subject)
    yield _count_rows(held)


#: A word counts at most so many times a document: what a text is about is said again and again, but one text is one voice.
REPEATS = 5


def _count(held: dict, words: Counter, subject: int) -> None:
    for w, n in words.items():
        at = held.get((w, subject))
        if at is None:
            held[w, subject] = [min(n, REPEATS), 1]
        else:
            at[0] += min(n, REPEATS)
            at[1] += 1


COUNTED = "word string, subject int, n bigint, docs bigint"


def _count_rows(held: dict) -> pa.RecordBatch:
    columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(2))]
    return pa.RecordBatch.from_arrays(columns, ["word", "subject", "n", "docs"])


def _lexicon(counts: DataFrame) -> dict[str, int]:
    """word -> subject of counts(word, subject, n, docs), of words that tell: at most LEXICON a subject reach the driver."""
    words = counts.groupBy("word", "subject").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per = words.groupBy("word").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("subject")).alias("s"), "docs")).alias("x"))
    told = per.select("word", (-F.col("x.s")).alias("subject"), F.col("x.docs").alias("n"), ((F.col("x.n") + 0.5) / (F.col("all") + 2)).alias("share"))
    kept = told.where((F.col("n") >= SEEN) & (F.col("share") >= TELLING)).withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc(F.col("share") * F.log1p("n")), "word")))
    return {r["word"]: r["subject"] for r in kept.where(F.col("r") <= LEXICON).select("word", "subject").collect()}


def _taught(lexicon: dict[str, int], count: int):
    """(word, subject, n) of documents that are surely about one subject."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = Counter(x.lower() for x in WORD.findall(text))
                votes = [0] * count
                for w in words.keys() & lexicon.keys():
                    votes[lexicon[w]] += words[w]
                best = max(votes)
                if best >= TEACH and best >= SURE * sum(votes):
                    _count(held, words, votes.index(best))
            if len(held) > 400_000:
                yield _count_rows(held)
                held = {}
        yield _count_rows(held)

    return run


def _functions(lexicon: dict[str, int], source_of: dict[str, int], count: int):
    """(doc, subject, lexicon, section, title, address, source): what each labelling function says of each subject that a document mentions.

    lexicon: the share of the subject's words among all telling words, in LEVELS; section: the same of sentences, each
    counted for the subject most of its words tell, with the share of sentences that tell none cutting it down; title and
    address: 1 if a word of the subject stands there; source: 1 if most of the source is on it; else they abstain."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                votes, parts, telling, dumb = [0] * count, [0.0] * count, 0, 0
                for sentence in SENTENCE.findall(text):
                    own = [lexicon[w] for w in map(str.lower, WORD.findall(sentence)) if w in lexicon]
                    if own:
                        telling += 1
                        for s in own:
                            votes[s] += 1
                        top = Counter(own).most_common()
                        ties = [s for s, n in top if n == top[0][1]]
                        for s in ties:
                            parts[s] += 1 / len(ties)
                    elif len(sentence) > 20:
                        dumb += 1
                total = sum(votes)
                if not total:
                    continue
                first = next((x for x in text.splitlines() if x.strip() and "@" not in x), "")
                title = {lexicon[w] for w in map(str.lower, WORD.findall(first[:100])) if w in lexicon}
                address = {lexicon[w] for m in ADDRESS.findall(text) for w in map(str.lower, WORD.findall(m)) if w in lexicon} if "@" in text or "/" in text else set()
                at = source_of.get(source)
                for s in range(count):
                    if votes[s]:
                        out.append((
                            doc, s, min(LEVELS, int(LEVELS * votes[s] / total)), min(LEVELS, int(LEVELS * parts[s] / (telling + dumb))),
                            int(s in title), int(s in address), int(at == s),
                        ))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int32()) for c in columns[1:])], ["doc", "subject", *NAMES])

    return run


NAMES = ["lexicon", "section", "title", "address", "source"]
SIZES = [LEVELS + 1, LEVELS + 1, 2, 2, 2]


def _smooth(table: np.ndarray) -> np.ndarray:
    """Neighbouring levels are alike: a kernel over each axis of the levels."""
    for axis in range(table.ndim):
        padded = np.pad(table, [(1, 1) if a == axis else (0, 0) for a in range(table.ndim)], mode="edge")
        table = np.apply_along_axis(lambda x: np.convolve(x, [0.25, 0.5, 0.25], "valid"), axis, padded)
    return table


def _posterior(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """P(about | what the functions say) of each pattern. The latent state of a subject in a document is a mention, one of two
    subjects, or the main one; how the functions answer in each state is learned by expectation-maximisation over all documents; known(pattern, no/yes)
    adds the labelled ones. A document is about a subject in the last two states.

    Lexicon and section say much the same, so their joint answer is learned; the others answer independently given the state, with VOICE. The states begin by
    the shares, which stay a prior of weight ANCHOR; no pattern is held to a state."""
    lexicon, section = patterns[:, 0], patterns[:, 1]
    share = lexicon / LEVELS
    begin = np.where((share < MENTIONED) | (section < SECTION * LEVELS), 0, np.where(share < MAIN, 1, 2))
    p = prior = np.where(np.arange(3)[:, None] == begin, 0.96, 0.02)
    for _ in range(ROUNDS):
        about = p[1:] / p[1:].sum(0)
        weight = (p + ANCHOR * prior) * counts
        weight[0] += known[:, 0]
        weight[1:] += about * known[:, 1]
        score = np.log(weight.sum(1) / weight.sum())[:, None].repeat(p.shape[1], 1)
        for y in range(3):
            joint = _smooth(np.bincount(lexicon * (LEVELS + 1) + section, weight[y], (LEVELS + 1) ** 2).reshape(LEVELS + 1, -1))
            apart = np.outer(joint.sum(1) + 0.5, joint.sum(0) + 0.5)
            joint = joint + PRIOR * apart / apart.sum()
            score[y] += np.log(joint / joint.sum())[lexicon, section]
            for k in range(2, len(SIZES)):
                table = np.bincount(patterns[:, k], weight[y], SIZES[k]) + 0.5
                score[y] += VOICE * np.log(table / table.sum())[patterns[:, k]]
        new = np.exp(score - score.max(0))
        new /= new.sum(0)
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p[1] + p[2]


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject of each subject (spelled as in subjects) that a text as a whole is about: none, one or two.

    Null and empty texts and texts without telling words have none, as has everything where no label is usable;
    labels count once a document and subject whatever their case and blanks, unknown ones not at all; null ids are
    left out, ids are unique; other columns are ignored; empty tables give no rows.

    The lexicon is seeded by at most LABELLED labelled documents and learned again over all documents. The labelling functions'
    answers are counted by pattern (a few thousand at most) over all documents; the latent model is fitted to these counts.
    """
    spark = documents.sparkSession
    names = [r[0] for r in subjects.where(F.col("subject").isNotNull()).select("subject").distinct().orderBy("subject").limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more subjects than a lexicon may hold")
    key = spark.createDataFrame([(n.strip().lower(), i) for i, n in enumerate(names)], "key string, subject int")
    docs = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "source"), "doc_id")
    labelled = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("key")).join(F.broadcast(key), "key").select("doc_id", "subject").distinct()
    sample = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    labelled = written(labelled.join(sample, "doc_id"))
    single = labelled.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count("*").alias("n")).where(F.col("n") == 1)
    # the labelled are few by their bound: what they join is cut down before it moves
    seed = _lexicon(docs.join(F.broadcast(single), "doc_id").select("text", "subject").mapInArrow(_seed_counts, COUNTED))
    lexicon = _lexicon(docs.select("doc_id", "text").mapInArrow(_taught(seed, len(names)), COUNTED)) if seed else {}
    lexicon = seed | lexicon
    by_source = docs.where(F.col("source").isNotNull()).join(F.broadcast(single), "doc_id").groupBy("source", "subject").agg(F.count("*").alias("n"))
    most = by_source.groupBy("source").agg(F.sum("n").alias("all"), F.max(F.struct("n", "subject")).alias("x")).where((F.col("all") >= 10) & (F.col("x.n") >= 0.6 * F.col("all")))
    source_of = {r[0]: r[1] for r in most.select("source", "x.subject").collect()}  # at most LABELLED / 10
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc {kind}, subject int, " + ", ".join(f"{n} int" for n in NAMES)
    said = written(docs.mapInArrow(_functions(lexicon, source_of, len(names)), schema))
    truth = labelled.select(F.col("doc_id").alias("doc"), "subject", F.lit(1).alias("yes"))
    marked = said.join(F.broadcast(sample.select(F.col("doc_id").alias("doc"), F.lit(1).alias("seen"))), "doc", "left").join(F.broadcast(truth), ["doc", "subject"], "left")
    rows = marked.groupBy(*NAMES).agg(
        F.count("*").alias("n"), F.count("yes").alias("yes"), F.count(F.when(F.col("yes").isNull(), F.col("seen"))).alias("no")
    ).collect()
    if not rows:
        return said.select(F.col("doc").alias("doc_id"), F.lit("").alias("subject"))
    patterns = np.array([[r[n] for n in NAMES] for r in rows])
    p = _posterior(patterns, np.array([r["n"] for r in rows], float), np.array([[r["no"], r["yes"]] for r in rows], float))
    good = spark.createDataFrame([(*map(int, x), float(q)) for x, q in zip(patterns, p) if q >= 0.5], ", ".join(f"{n} int" for n in NAMES) + ", p double")
    spelled = spark.createDataFrame(list(enumerate(names)), "subject int, name string")
    chosen = said.join(F.broadcast(good), NAMES).withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("p"), F.desc("lexicon"), "subject"))).where(F.col("r") <= 2)
    return chosen.join(F.broadcast(spelled), "subject").select(F.col("doc").alias("doc_id"), F.col("name").alias("subject"))
