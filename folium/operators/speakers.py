"""Who says a quote: names beside verbs of speech, joined with quotes by distance.

Tokens, quotes and mentions are rows with offsets. A mention is a name or alias
that stands before or behind a verb of speech and outside all quotes. It
is a cue of the quotes within ``CUE_CHARS`` characters that no other quote
parts from it; the join runs on bins of that width. Before a quote only "name
verb" counts, and only without the end of a sentence between them; behind a
quote "verb name" counts too, unless another name stands before that verb. One
character among a quote's cues is its speaker; several leave it open.

Running maxima over the rows of a paragraph answer "does a quote hold this
place" and "does a quote stand between", so no quote is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import scan
from folium.functions.text import normalize_case_insensitive

# Verbs of speech, pronouns that may stand in a cue, marks that end a sentence, and the names of the methods.
SPEECH_VERBS = (
    "say", "says", "said", "ask", "asks", "asked", "reply", "replies", "replied", "answer", "answers", "answered", "whisper", "whispers", "whispered", "murmur", "murmurs", "murmured",
    "mutter", "mutters", "muttered", "shout", "shouts", "shouted", "yell", "yells", "yelled", "cry", "cries", "cried", "exclaim", "exclaims", "exclaimed", "add", "adds", "added",
    "observe", "observes", "observed", "call", "calls", "called",
)
PRONOUNS = ("he", "she", "they", "i", "we", "you")
STOPS = ".!?؟"
BY_NAME, BY_ALIAS, BY_PRONOUN, AMBIGUOUS, NO_CUE = "explicit_name_speech_verb", "explicit_alias_speech_verb", "pronoun_speech_verb_unresolved", "ambiguous_explicit_candidates", "no_speaker_cue"
CUE_CHARS = 96
CONTEXT_QUOTES, EXCERPT_CHARS = 16, 90
CONTEXT_HEAD = "SPEAKER MAP — deterministic explicit evidence only; unresolved dialogue is omitted:"

LEXICAL = r"\p{IsAlphabetic}\p{N}'’-"
GLUE = "\x1f"


def lexical_tokens(rows: DataFrame, key: str = "paragraph", text: str = "text") -> DataFrame:
    """(key, n, raw, norm, start, end, stop): words of each text with their offsets in code points, end exclusive.

    A word is a run of letters, digits, apostrophes and hyphens; one whose
    normalised form is empty is left out. n counts from 0; stop is where the
    next mark that ends a sentence stands (null: nowhere). Null and empty texts
    have no words. Keys are unique.
    """
    pieces = rows.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"([{LEXICAL}]+|[^{LEXICAL}]+)"), 1)).alias("pos", "raw"))
    along = Window.partitionBy("key").orderBy("pos")
    end = F.sum(F.length("raw")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    mark = F.regexp_instr("raw", F.lit(f"[{STOPS}]"))
    placed = pieces.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("raw"))
    placed = placed.withColumn("stop", F.min(F.when(mark > 0, F.col("start") + mark - 1)).over(along.rowsBetween(0, Window.unboundedFollowing)).cast("int"))
    words = placed.filter(F.rlike("raw", F.lit(f"^[{LEXICAL}]"))).withColumn("norm", normalize_case_insensitive(F.col("raw"))).filter("norm <> ''")
    return words.select(F.col("key").alias(key), (F.row_number().over(along) - 1).alias("n"), "raw", "norm", "start", "end", "stop")


def quote_rows(rows: DataFrame, key: str = "paragraph", text: str = "text") -> DataFrame:
    """(key, quote_index, start, end, style, quote) of every quoted span."""
    return rows.select(F.col(key), F.posexplode(scan.quotes(text)).alias("quote_index", "q")).select(key, "quote_index", "q.*")


def name_patterns(profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, mention, alias, phrase, size): names as normalised words; ``profiles`` has name, ``aliases`` canonical_name and alias."""
    rows = profiles.select(F.col("name").alias("canonical"), F.col("name").alias("mention"), F.lit(False).alias("alias"))
    rows = rows.unionByName(aliases.select(F.col("canonical_name").alias("canonical"), F.col("alias").alias("mention"), F.lit(True).alias("alias")))
    parts = F.filter(F.transform(F.regexp_extract_all("mention", F.lit(f"([{LEXICAL}]+)"), 1), normalize_case_insensitive), lambda x: x != "")
    return rows.distinct().withColumn("w", parts).filter(F.size("w") > 0).select("canonical", "mention", "alias", F.array_join("w", GLUE).alias("phrase"), F.size("w").alias("size"))


def _outside(mentions: DataFrame, quotes: DataFrame) -> DataFrame:
    """Mentions (key, m_start, m_end, ...) that no quote holds: the furthest end of the quotes that begin before it lies before its end."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in mentions.schema.fields if f.name not in ("key", "m_start")]
    events = mentions.withColumns({"kind": F.lit(1), "reach": F.lit(None).cast("int")})
    events = events.unionByName(quotes.select("key", F.col("start").alias("m_start"), *blank, F.lit(0).alias("kind"), F.col("end").alias("reach")))
    far = F.max("reach").over(Window.partitionBy("key").orderBy("m_start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("reach", far).filter((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") < F.col("m_end")))).drop("kind", "reach")


def _neighbours(quotes: DataFrame) -> DataFrame:
    """Each quote with ``last_start``, the greatest start of the quotes that end before it, and ``next_end``, the least end of those that begin behind it."""
    facts = ["key", "quote_index", "start", "end"]
    ask = quotes.select(*facts, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("x"))
    # an empty quote ends where it begins: it comes behind the question for its own place
    tell = quotes.select("key", F.lit(None).cast("int").alias("quote_index"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("end").alias("at"), F.when(F.col("end") == F.col("start"), 2).otherwise(0).alias("kind"), F.col("start").alias("x"))
    upwards = Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = ask.unionByName(tell).withColumn("last_start", F.max("x").over(upwards)).filter("kind = 1").select("key", "quote_index", "last_start")
    ask = quotes.select(*facts, F.col("end").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("x"))
    tell = quotes.select("key", F.lit(None).cast("int").alias("quote_index"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.col("start").alias("at"), F.when(F.col("end") == F.col("start"), 2).otherwise(0).alias("kind"), F.col("end").alias("x"))
    downwards = Window.partitionBy("key").orderBy(F.desc("at"), F.asc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    following = ask.unionByName(tell).withColumn("next_end", F.min("x").over(downwards)).filter("kind = 1").select("key", "quote_index", "next_end")
    return quotes.join(last, ["key", "quote_index"]).join(following, ["key", "quote_index"])


def _cues(tokens: DataFrame, quotes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Names beside verbs of speech: key, m_start, m_end, subject, verb_start, verb_end, stop, canonical, mention, alias, evidence, size."""
    sizes = sorted(r[0] for r in patterns.select("size").distinct().collect())  # lengths of names in words: a handful
    along = Window.partitionBy("key").orderBy("n")
    sides, wide = [], {}
    for k in sizes:
        after, before = along.rowsBetween(1, k), along.rowsBetween(-k, -1)
        for name, w in (("after", after), ("before", before)):
            wide[f"{name}_{k}"] = F.struct(F.collect_list("norm").over(w).alias("w"), F.first("start").over(w).alias("s"), F.last("end").over(w).alias("e"))
            sides.append(F.struct(F.lit(k).alias("size"), F.lit(name == "before").alias("subject"), F.array_join(f"{name}_{k}.w", GLUE).alias("phrase"), F.size(f"{name}_{k}.w").alias("found"), F.col(f"{name}_{k}.s").alias("m_start"), F.col(f"{name}_{k}.e").alias("m_end")))
    if not sizes:
        sides.append(F.struct(F.lit(0).alias("size"), F.lit(False).alias("subject"), F.lit("").alias("phrase"), F.lit(-1).alias("found"), F.lit(0).alias("m_start"), F.lit(0).alias("m_end")))
    verbs = tokens.withColumns(wide).filter(F.col("norm").isin(*SPEECH_VERBS))
    near = verbs.select("key", "raw", F.col("start").alias("verb_start"), F.col("end").alias("verb_end"), "stop", F.explode(F.array(*sides)).alias("c")).select("key", "raw", "verb_start", "verb_end", "stop", "c.*").filter("found = size")
    named = near.drop("found").join(patterns, ["phrase", "size"])
    evidence = F.when(F.col("subject"), F.concat_ws(" ", "mention", "raw")).otherwise(F.concat_ws(" ", "raw", "mention"))
    named = named.withColumn("evidence", evidence).drop("raw", "phrase")
    # a name between two verbs is the subject of the second
    both = Window.partitionBy("key", "canonical", "mention", "alias", "m_start")
    return _outside(named.withColumn("leads", F.max("subject").over(both)).filter(F.col("subject") == F.col("leads")).drop("leads"), quotes)


def _pronoun_cues(tokens: DataFrame, quotes: DataFrame) -> DataFrame:
    """Pronouns beside verbs of speech: key, m_start, m_end, subject."""
    along = Window.partitionBy("key").orderBy("n")
    verb = F.col("norm").isin(*SPEECH_VERBS)
    sides = tokens.withColumn("then", F.coalesce(F.lead(verb).over(along), F.lit(False))).withColumn("since", F.coalesce(F.lag(verb).over(along), F.lit(False)))
    found = sides.filter(F.col("norm").isin(*PRONOUNS) & (F.col("then") | F.col("since")))
    return _outside(found.select("key", F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("then").alias("subject")), quotes)


def _near(cues: DataFrame, quotes: DataFrame) -> DataFrame:
    """Cues with the quotes that they may belong to, on either side."""
    wide = CUE_CHARS + 1
    q = quotes.select("key", "quote_index", F.col("start").alias("q_start"), F.col("end").alias("q_end"), "last_start", "next_end")
    cell = lambda c: F.floor(F.col(c) / wide)
    ahead = q.withColumn("cell", F.explode(F.array(cell("q_start") - 1, cell("q_start"))))
    before = cues.filter("subject").withColumn("cell", cell("m_end")).join(ahead, ["key", "cell"])
    before = before.filter((F.col("q_start") - F.col("m_end")).between(0, CUE_CHARS) & (F.col("last_start").isNull() | (F.col("last_start") < F.col("m_end"))))
    if "stop" in cues.columns:
        before = before.filter(F.col("stop").isNull() | (F.col("stop") >= F.col("q_start")))
    behind = q.withColumn("cell", F.explode(F.array(cell("q_end"), cell("q_end") + 1)))
    after = cues.withColumn("cell", cell("m_start")).join(behind, ["key", "cell"])
    after = after.filter((F.col("m_start") - F.col("q_end")).between(0, CUE_CHARS) & (F.col("next_end").isNull() | (F.col("next_end") > F.col("m_start"))))
    return before.unionByName(after)


def attribute(paragraphs: DataFrame, profiles: DataFrame, aliases: DataFrame, key: str = "paragraph", text: str = "text") -> DataFrame:
    """(key, quote_index, start, end, style, quote, speaker, mention, method, evidence) of every quote.

    ``paragraphs`` has a unique key and a text; ``profiles`` has name,
    ``aliases`` canonical_name and alias. A speaker is named by one character's
    name or alias alone; several characters are ambiguous (evidence lists
    them), a pronoun beside a verb of speech stays unresolved. Texts without
    quotes, null texts and empty tables give no rows.
    """
    quotes = quote_rows(paragraphs, key, text).withColumnRenamed(key, "key")
    spoken = paragraphs.join(quotes.select(F.col("key").alias(key)).distinct(), key, "left_semi")
    tokens = lexical_tokens(spoken, key, text).withColumnRenamed(key, "key")
    placed = _neighbours(quotes)
    found = _near(_cues(tokens, quotes, name_patterns(profiles, aliases)), placed)
    verb = Window.partitionBy("key", "quote_index", "verb_start", "verb_end")
    found = found.withColumn("leads", F.max("subject").over(verb)).filter(F.col("subject") | ~F.col("leads"))
    first = F.struct((-F.col("size")).alias("size"), "canonical", "mention", "alias", "m_start", "evidence")
    people = found.groupBy("key", "quote_index", normalize_case_insensitive(F.col("canonical")).alias("who")).agg(F.min(first).alias("c"))
    heard = people.groupBy("key", "quote_index").agg(F.count(F.lit(1)).alias("people"), F.min("c").alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("who", "c.canonical"))), lambda x: x["canonical"]), " | ").alias("all"))
    pronoun = _near(_pronoun_cues(tokens, quotes), placed).select("key", "quote_index", F.lit(True).alias("pronoun")).distinct()
    out = quotes.join(heard, ["key", "quote_index"], "left").join(pronoun, ["key", "quote_index"], "left")
    one = F.col("people") == 1
    method = F.when(one, F.when(F.col("c.alias"), BY_ALIAS).otherwise(BY_NAME)).when(F.col("people") > 1, AMBIGUOUS).when(F.col("pronoun"), BY_PRONOUN).otherwise(NO_CUE)
    return out.select(
        F.col("key").alias(key), "quote_index", "start", "end", "style", "quote", F.when(one, F.col("c.canonical")).alias("speaker"), F.when(one, F.col("c.mention")).alias("mention"),
        method.alias("method"), F.when(one, F.col("c.evidence")).when(F.col("people") > 1, F.col("all")).alias("evidence"),
    )


def quoted_excerpt(quote: Column) -> Column:
    """A quote's first characters as a string literal: quotation marks, backslashes and line ends escaped."""
    body = F.regexp_replace(quote, f"^[{scan.WHITE_SPACE}]+|[{scan.WHITE_SPACE}]+$", "")
    cut = F.when(F.length(body) > EXCERPT_CHARS, F.concat(F.left(body, F.lit(EXCERPT_CHARS)), F.lit("…"))).otherwise(body)
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        cut = F.replace(cut, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), cut, F.lit('"'))


def speaker_context(attributed: DataFrame, key: str = "paragraph") -> DataFrame:
    """(key, context): the first quotes with a known speaker as lines under a heading; texts without any have no row."""
    line = F.concat(F.lit("- "), quoted_excerpt(F.col("quote")), F.lit(" → "), F.col("speaker"), F.lit(" ("), F.col("method"), F.lit(")"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("quote_index"))
    first = attributed.filter("speaker IS NOT NULL").withColumn("r", rank).filter(F.col("r") <= CONTEXT_QUOTES).withColumn("line", line)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])
    return first.groupBy(key).agg(F.array_join(F.concat(F.array(F.lit(CONTEXT_HEAD)), lines), "\n").alias("context"))
