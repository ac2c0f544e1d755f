"""Problem 10: subject areas of documents, by propagating labels over a verified graph of documents that share words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, read_spread

_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")
_LINES = re.compile(r"\r\n|\n|\r")
# Lines that name people, dates, hashes and modes in the common export forms of commits.
_HEADER = re.compile(
    r"\W{0,8}(\[\d+m)?(commit [0-9a-f]{7}|Author:|AuthorDate|Commit:|CommitDate|Date:|From [0-9a-f]{7}|From:|# User|# Node|# Date|# HG|# Parent|index [0-9a-f]{6}"
    r"|new file|deleted file|old mode|new mode|similarity|rename|GIT binary|literal \d|z\S{30}|\d+ files? changed)"
)
# Words that stand between the words of a term.
_BETWEEN = frozenset(("of", "the", "a", "an", "de", "del", "la", "le", "du", "des", "der", "die", "das"))


def lines_of(text: str) -> list[str]:
    """Lines that carry content. A JSON export is read as the text it quotes; headers and hunk marks are left out."""
    if text.lstrip("\ufeff\u200b\x0c ").startswith('{"'):
        text = text.replace("\\r", "").replace("\\n", "\n").replace("\\t", "\t").replace('\\"', '"')
        text = re.sub(r'"(commit|author)":"[^"]*",?', "", text)
    out = []
    for line in _LINES.split(text):
        if line.startswith("@@"):
            line = line.rpartition("@@")[2]
        elif line.startswith("diff --git "):
            line = line[11:].partition(" b/")[0]
        elif line.startswith(("--- ", "+++ ")) or _HEADER.match(line):
            continue
        out.append(line)
    return out


def word_pairs(text: str) -> dict[tuple[str, str], int]:
    """Counts of (word, word before it in the same line or ""); identifiers are cut into words."""
    found: dict[tuple[str, str], int] = {}
    for line in lines_of(text):
        before = ""
        for word in _WORD.findall(_CAMEL.sub(" ", line)):
            word = word.lower()
            if word in _BETWEEN or len(word) < 2:
                continue
            pair = (word, before)
            found[pair] = found.get(pair, 0) + 1
            before = word
    return found


def _word_table(documents: DataFrame) -> DataFrame:
    """(doc_id, words ARRAY<STRUCT<w, p, first>>): hashes of the distinct pairs of each text; ``first`` marks one
    of the pairs of each word."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {"": 0}

        def number(word: str) -> int:
            if (n := known.get(word)) is None:
                if len(known) > 500_000:
                    known.clear()
                    known[""] = 0
                n = xxhash.xxh64_intdigest(word)
                n = known[word] = n - (1 << 64) if n >= 1 << 63 else n
            return n

        for batch in batches:
            ws, ps, cs, firsts, offsets = [], [], [], [], [0]
            for text in batch.column(1).to_pylist():
                seen = set()
                for (word, before), n in word_pairs(text).items() if text else ():
                    ws.append(number(word))
                    ps.append(number(before))
                    cs.append(n)
                    firsts.append(word not in seen)
                    seen.add(word)
                offsets.append(len(ws))
            items = pa.StructArray.from_arrays([pa.array(ws, pa.int64()), pa.array(ps, pa.int64()), pa.array(cs, pa.int32()), pa.array(firsts, pa.bool_())], names=["w", "p", "n", "first"])
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.array(offsets, np.int32)), items)], names=["doc_id", "words"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words array<struct<w: bigint, p: bigint, n: int, first: boolean>>")


#: Words of a lexicon that are sent to all workers; a larger one is joined by a shuffle.
MOST_SENT = 100_000
#: Subject areas of one job.
MOST_SUBJECTS = 10_000
#: Word rows of a bucket of the word table.
PER_BUCKET = 2_000_000


def _sent(lexicon: DataFrame) -> DataFrame:
    """The lexicon, for a join: sent to all workers if its counted size allows."""
    return F.broadcast(lexicon) if lexicon.count() <= MOST_SENT else lexicon.hint("merge")


def _edges(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The links of the document graph, (doc_id, anchor, subject, w, n): from each document to the anchor of each verified
    word it has, where a run of words of one subject begins; n is how often. A document has at most one link for each of
    its words, so a word of a third of all documents costs a row each, and pairs of its documents are never built."""
    sent = _sent(lexicon.select("w", "subject", "anchor"))
    before = _sent(lexicon.select(F.col("w").alias("p"), F.col("subject").alias("before")))
    return words.join(sent, "w").join(before, "p", "left").where("before is null or before <> subject").groupBy("doc_id", "anchor", "subject", "w").agg(F.sum("n").alias("n"))


def _reached(edges: DataFrame, least: int) -> DataFrame:
    """(doc_id, subject, mentions) of documents that labels reach: along links of two different words at least, with
    ``least`` mentions or more. A single word, however often, may be half of a term of another subject."""
    counted = edges.groupBy("doc_id", "subject").agg(F.sum("n").alias("mentions"), F.min("w").alias("lo"), F.max("w").alias("hi"))
    return counted.where((F.col("mentions") >= least) & (F.col("lo") < F.col("hi"))).select("doc_id", "subject", "mentions")


def _beliefs(mentions: DataFrame) -> DataFrame:
    """(doc_id, subject, belief): shares of the mentions of the subjects a document isn't only touching in passing."""
    total = F.sum("mentions").over(Window.partitionBy("doc_id"))
    return mentions.select("doc_id", "subject", (F.col("mentions") / total).alias("belief"))


def _lexicon(words: DataFrame, beliefs: DataFrame, frequency: DataFrame, share: float, support: float, lift: float) -> DataFrame:
    """Verified words, (w, subject, anchor): their documents believe in one subject, and the anchor is the document that
    believes most in it (of equals a hash decides). ``lift`` is the share of the documents of a word that must hold a
    belief at all; words of documents without any subject (merges, robots) fail it."""
    # one number orders by belief, then by a hash of the id: aggregates of numbers don't sort
    order = F.shiftleft((F.col("belief") * 1_000_000).cast("bigint"), 40) + F.shiftrightunsigned(F.xxhash64("doc_id"), 24)
    votes = words.where("first").join(beliefs.hint("shuffle_hash"), "doc_id").groupBy("w", "subject").agg(F.sum("belief").alias("vote"), F.max_by("doc_id", order).alias("d"))
    # a word that passes has more than half of its votes for one subject, so there is no tie
    best = votes.groupBy("w").agg(F.sum("vote").alias("votes"), F.max("vote").alias("vote"), F.max_by("subject", "vote").alias("subject"), F.max_by("d", "vote").alias("anchor"))
    ok = (F.col("vote") >= share * F.col("votes")) & (F.col("votes") >= support) & (F.col("votes") >= lift * F.col("df"))
    return best.join(frequency.hint("merge"), "w").where(ok).select("w", "subject", "anchor")


def _state(labels: DataFrame) -> tuple[int, int]:
    """What tells two sets of labels apart: their number and a hash of all of them."""
    h = F.xxhash64("doc_id", "subject")
    return tuple(labels.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0))).first())


def assign_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, rounds: int = 20, least: int = 2, max_share: float = 0.4) -> DataFrame:
    """(doc_id, subject) for each subject a document is about; none, one or several rows a document.

    The graph links each document to anchor documents it shares words with, one for each word. A link must be verified: a
    word links only if the documents that have it agree on one subject, and a label passes only where links of two
    different words bring it. Seeds are the labelled documents; a seed whose own words don't bear out its label isn't
    trusted. In each round labels go from documents to words (which are verified anew), and along the links of the graph
    back to documents, all by joins; trusted seeds are clamped to their labels. Rounds go on until no label changes, or
    until labels come back to an earlier state, at most ``rounds`` times. A document keeps every subject that reaches it
    with at least ``least`` separate mentions (runs of adjacent words count once), and a trusted seed its own; a single
    word in passing is no case.

    Words in fewer than three documents or in more than ``max_share`` of all link nothing. Null, empty and blank texts and
    null ids get no subject. Rows of a repeated doc_id count once. Labels of unknown documents or subjects are ignored;
    without labels there are no rows. Extra columns are ignored.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "subjects")
    texts = documents.where("doc_id is not null and text is not null and text <> ''")
    table = scratch.table(_word_table(texts), "words")
    n, different, rows = table.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if different < n:
        table, n = scratch.table(table.dropDuplicates(["doc_id"]), "words"), different
    flat = table.select("doc_id", F.explode("words").alias("x")).select("doc_id", "x.w", "x.p", "x.n", "x.first")
    counted = flat.where("first").groupBy("w").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= 3) & (F.col("df") <= max(3.0, max_share * n)))
    frequency = scratch.table(counted, "frequency")
    # in buckets of doc_id, so that no round shuffles the words again
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / PER_BUCKET))
    words = scratch.bucketed(flat.join(frequency.select("w"), "w"), "flat", buckets, "doc_id")
    scratch.drop(table)

    listed = [r["subject"] for r in areas.where("subject is not null").select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(listed) > MOST_SUBJECTS:
        raise ValueError(f"at most {MOST_SUBJECTS} subject areas")
    names = F.broadcast(spark.createDataFrame(list(enumerate(listed)), "code int, name string"))
    coded = labels.select("doc_id", "subject").join(names, F.col("subject") == F.col("name")).where("doc_id is not null")
    given = scratch.table(coded.select("doc_id", F.col("code").alias("subject")).distinct(), "given")
    seeds = given.select("doc_id", "subject", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).alias("belief"))
    rate = given.select("doc_id").distinct().count() / max(1, n)
    seeded = words.join(given.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    lexicon = scratch.table(_lexicon(words, seeds, frequency, 0.55, 2, 0.3 * rate), "lexicon")
    borne_out = _reached(_edges(seeded, lexicon), least).join(given.hint("merge"), ["doc_id", "subject"])
    trusted = scratch.table(borne_out.select("doc_id", "subject", "mentions"), "trusted")
    clamped = trusted.select("doc_id").distinct()
    lexicon = scratch.table(_lexicon(words, _beliefs(trusted), frequency, 0.65, 2, 0.3 * rate), "lexicon")

    states: set[tuple[int, int]] = set()
    for _ in range(rounds):
        reached = _reached(_edges(words, lexicon), least)
        # within the graph a trusted seed holds its labels and nothing else
        held = scratch.table(reached.join(clamped.hint("merge"), "doc_id", "left_anti").unionByName(trusted), "labels")
        if (state := _state(held)) in states:
            break
        states.add(state)
        following = scratch.table(_lexicon(words, _beliefs(held), frequency, 0.7, 2, 0.6), "lexicon")
        scratch.drop(lexicon)
        lexicon = following
    found = _reached(_edges(words, lexicon), least).select("doc_id", "subject").unionByName(trusted.select("doc_id", "subject")).distinct()
    return found.join(names, F.col("subject") == F.col("code")).select("doc_id", F.col("name").alias("subject"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return assign_subjects(read_spread(spark, f"{sf_dir}/documents.parquet"), read("subject_areas"), read("subject_labels"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subject area: documents about it, and their share of all documents with a subject."""
    found = p10_found(spark, sf_dir)
    areas = spark.read.parquet(f"{sf_dir}/subject_areas.parquet").select("subject").distinct()
    counts = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    out = areas.join(counts, "subject", "left").select("subject", F.coalesce("documents", F.lit(0)).alias("documents"))
    total = F.sum("documents").over(Window.partitionBy(F.lit(1)))
    return out.select("subject", "documents", F.round(F.col("documents") / F.greatest(total, F.lit(1)), 6).alias("share"))
