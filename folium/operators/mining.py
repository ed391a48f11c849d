"""Mining of phrases, names and profiles with bounded evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.ids import confidence, stable_id
from folium.functions.text import NAME_STOPWORDS, count_sentences, dialogue_conventions, ngrams, normalize_case_insensitive, phrase_tokens, words

EVIDENCE = 8
#: Chapters whose indexes share this quotient are ranked together; the middle of a book is sought in one such run.
RUN_CHAPTERS = 4_096


def recurring_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = (2, 3), least: int = 3, evidence: int = EVIDENCE) -> DataFrame:
    """(phrase, n, n_docs, first_doc, evidence, confidence): phrases that occur ``least`` times or more.

    Phrases of stop words alone are left out. One shuffle, by phrase, carries
    the occurrences; counts of documents, sums and evidence, the least few ids,
    all come from its order, and never from a whole list.
    """
    tokenised = docs.select(F.col(doc_id).alias("doc_id"), phrase_tokens(F.col(text)).alias("w"))
    grams = tokenised.select("doc_id", F.explode(F.concat(*[ngrams(F.col("w"), n) for n in sizes])).alias("phrase"))
    stop = F.forall(F.split("phrase", " "), lambda x: x.isin(*NAME_STOPWORDS))
    by_doc = grams.filter(~stop).repartition("phrase").groupBy("phrase", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("doc_id"))
    refs = F.array_sort(F.collect_list(F.when(F.col("r") <= evidence, F.col("doc_id"))))
    found = by_doc.withColumn("r", rank).groupBy("phrase").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), refs.alias("evidence"))
    return found.filter(F.col("n") >= least).withColumn("confidence", confidence(F.col("n")))


def name_counts(mentions: DataFrame, doc_id: str = "doc_id", name: str = "name", position: str = "position", least: int = 2, evidence: int = EVIDENCE) -> DataFrame:
    """(key, display, n, evidence, confidence) of names by normalised key; the display form is the first one met.

    Without ``evidence`` (0) that column is left out, and names are counted as
    they are spelt before they meet by key.
    """
    if not evidence:
        spelt = mentions.groupBy(F.col(name).alias("name")).agg(F.min(F.struct(F.col(doc_id).alias("doc_id"), F.col(position).alias("position"))).alias("first"), F.count(F.lit(1)).alias("c"))
        counted = spelt.withColumn("key", normalize_case_insensitive(F.col("name"))).filter("key <> ''")
        return counted.groupBy("key").agg(F.min_by("name", "first").alias("display"), F.sum("c").alias("n")).filter(F.col("n") >= least).withColumn("confidence", confidence(F.col("n")))
    keyed = mentions.select(F.col(doc_id).alias("doc_id"), F.col(name).alias("name"), F.col(position).alias("position"), normalize_case_insensitive(F.col(name)).alias("key")).filter("key <> ''")
    by_doc = keyed.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.min_by("name", "position").alias("display"))
    out = by_doc.groupBy("key").agg(F.min_by("display", "doc_id").alias("display"), F.sum("c").alias("n")).filter(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    refs = by_doc.withColumn("r", rank).filter(F.col("r") <= evidence).groupBy("key").agg(F.array_sort(F.collect_list("doc_id")).alias("evidence"))
    return out.join(refs, "key").withColumn("confidence", confidence(F.col("n")))


def character_seeds(names: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(seed_id, position, key, name, n, confidence, approved) of counted names (key, display, n, confidence): most frequent first, then by name.

    A seed is approved if the canon has its name or an alias of it. Positions
    follow the order; they are found in runs of equal counts, so no task sorts
    all names.
    """
    known = profiles.select(normalize_case_insensitive(F.col("name")).alias("key")).unionByName(aliases.select(normalize_case_insensitive(F.col("alias")).alias("key"))).distinct().withColumn("approved", F.lit(True))
    runs = names.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    before = runs.withColumn("before", F.sum("c").over(Window.orderBy(F.desc("n"))) - F.col("c")).select("n", "before")
    inside = F.row_number().over(Window.partitionBy("n").orderBy("display", "key"))
    rows = names.withColumn("r", inside).join(before, "n").join(known, "key", "left")
    return rows.select(stable_id(F.lit("character"), F.col("key")).alias("seed_id"), (F.col("before") + F.col("r")).alias("position"), "key", F.col("display").alias("name"), "n", "confidence", F.coalesce("approved", F.lit(False)).alias("approved"))


def chapter_maps(facts: DataFrame, seeds: DataFrame, terms: DataFrame, by: list[str]) -> DataFrame:
    """``facts`` (one row for each chapter, keyed by ``by``) with the names and terms that stand in it, in their own order.

    ``seeds`` and ``terms``: the columns of ``by``, position and label.
    """
    out = facts
    for rows, name in ((seeds, "names"), (terms, "terms")):
        listed = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set(F.struct("position", "label"))), lambda x: x["label"]).alias(name))
        out = out.join(listed, by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def terminology(names: DataFrame, terms: DataFrame, phrases: DataFrame, glossary: DataFrame, most: int = 256) -> DataFrame:
    """(expression, origin, n, approved) of names, terms and phrases, at most ``most``: one row for a key, names first, then terms.

    Inputs have (expression, n); the glossary has (source_term, preferred_translation).
    """
    tagged = [df.select("expression", "n", F.lit(origin).alias("origin"), F.lit(rank).alias("rank")) for rank, (origin, df) in enumerate((("name", names), ("term", terms), ("phrase", phrases)))]
    union = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).withColumn("key", normalize_case_insensitive(F.col("expression")))
    first = union.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("rank", F.desc("n"), "expression"))).filter("r = 1")
    top = first.orderBy("rank", F.desc("n"), "expression").limit(most)
    approved = glossary.select(normalize_case_insensitive(F.col("source_term")).alias("key"), F.col("preferred_translation").alias("approved")).dropDuplicates(["key"])
    return top.join(approved, "key", "left").select("expression", "origin", "n", "approved")


def paragraph_facts(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """``paragraphs`` with n_chars, n_words, n_sentences, conventions and is_dialogue."""
    styles = dialogue_conventions(F.col(text))
    return paragraphs.withColumns({"n_chars": F.length(F.col(text)), "n_words": F.size(words(F.col(text))), "n_sentences": count_sentences(F.col(text)), "conventions": styles, "is_dialogue": F.size(styles) > 0})


def observed_profile(facts: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sentence length, dialogue and prose density and the dialogue conventions of each group."""
    n = F.count(F.lit(1))
    dialogue = F.round(F.avg(F.col("is_dialogue").cast("double")), 6)
    return facts.groupBy(*by).agg(
        n.alias("n_paragraphs"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"), F.sum("n_sentences").alias("n_sentences"),
        F.coalesce(F.round(F.try_divide(F.sum("n_words").cast("double"), F.sum("n_sentences")), 6), F.lit(0.0)).alias("sentence_words"),
        dialogue.alias("dialogue_density"), F.round(1 - F.avg(F.col("is_dialogue").cast("double")), 6).alias("prose_density"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("conventions")))), ",").alias("conventions"),
    )


def middle_rows(rows: DataFrame, book: str, order: str) -> DataFrame:
    """(book, order) of the row number ``count div 2`` of each book, from 0, by an integer order.

    Counts of runs of neighbouring orders tell which run holds the row; only that run is ranked.
    """
    runs = rows.groupBy(F.col(book).alias("b"), F.floor(F.col(order) / RUN_CHAPTERS).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("b").orderBy("run")
    placed = runs.withColumn("before", F.sum("n").over(along) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("b")))
    at = F.floor(F.col("all") / 2)
    chosen = placed.filter((F.col("before") <= at) & (at < F.col("before") + F.col("n"))).select("b", "run", (at - F.col("before")).alias("at"))
    inside = rows.select(F.col(book).alias("b"), F.col(order).alias("o"), F.floor(F.col(order) / RUN_CHAPTERS).alias("run")).join(chosen, ["b", "run"])
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("o")) - 1)
    return ranked.filter("r = at").select(F.col("b").alias(book), F.col("o").alias(order))


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` with the rank of an integer order, from 0, unique where the order is; runs of neighbouring orders are ranked on their own."""
    run = F.floor(F.col(order) / RUN_CHAPTERS)
    sizes = rows.groupBy(run.alias("__run")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__run")) - F.col("__n")).select("__run", "__before")
    inside = F.row_number().over(Window.partitionBy("__run").orderBy(order)) - 1
    return rows.withColumn("__run", run).withColumn("__r", inside).join(before, "__run").withColumn(name, F.col("__before") + F.col("__r")).drop("__run", "__r", "__before")


def position_samples(chapters: DataFrame, book: str = "book", order: str = "position", length: str = "n_chars", dialogue: str = "dialogue_density") -> DataFrame:
    """(book, position, reasons): the first, middle and last chapter, the longest by characters (ties: the last) and the one with most dialogue (ties: the first).

    Positions are integers. All but the middle are partial aggregates, and the
    middle is sought in one run of neighbouring chapters, so a book of very
    many chapters isn't sorted as one group.
    """
    rows = chapters.select(F.col(book).alias("book"), F.col(order).alias("position"), F.col(length).alias("l"), F.col(dialogue).alias("d"))
    ends = rows.groupBy("book").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.max(F.struct("l", "position")).alias("long"), F.max(F.when(F.col("d") > 0, F.struct("d", (-F.col("position")).alias("p")))).alias("talk"))
    reason = lambda name, c: F.struct(F.lit(name).alias("reason"), c.cast("bigint").alias("position"))
    chosen = ends.select("book", F.explode(F.array(reason("first", F.col("first")), reason("last", F.col("last")), reason("longest", F.col("long.position")), reason("dialogue", -F.col("talk.p")))).alias("x")).select("book", "x.*")
    middle = middle_rows(rows, "book", "position").select("book", F.lit("middle").alias("reason"), F.col("position").cast("bigint").alias("position"))
    found = chosen.filter("position IS NOT NULL").unionByName(middle).groupBy("book", "position").agg(F.collect_set("reason").alias("r"))
    ordered = F.filter(F.array(*map(F.lit, ("first", "middle", "last", "longest", "dialogue"))), lambda x: F.array_contains("r", x))
    return found.select("book", "position", F.array_join(ordered, ",").alias("reasons"))
