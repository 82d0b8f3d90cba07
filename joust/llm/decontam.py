"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders and punctuation goes, so a question with other figures or other
names has the template of the original. Hashed template windows at every word of both sides meet by equality. An
item's windows are as wide as the longest run that is left however its share of changed words is scattered (WINDOW
words at most), so each case of the share is proposed. What they propose (document, item, shift) is compared word by
word: enough of the item's words must agree in order, less one for each word put in between, and the slots of the
words that agree must be filled consistently: wherever the item has one value, the document has one value (two values
of the item may become the same). Neighbouring words of one name or number are one placeholder, a unit is one of its
own also where it is written onto its number. A capitalised word is a name also where it begins a sentence, since nothing
in a template tells the two apart: there it costs nothing, as both sides have it, and a slot has to be filled
consistently all the same. Spelled numbers are numbers.

Texts are compared once, whatever the number of their copies: documents and items are told apart by a hash of the
text, and ids come back at the end. A window of placeholders only, which many texts hold, is matched like any other;
with the benchmark's windows broadcast its matches stay on the partitions of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, scratch, small, stored, table
from .simhash import text_key

WINDOW = 4
SHARE = 0.8
#: A stretch of so many agreeing words counts also where it is less than SHARE of the item.
STRETCH = 13
#: Benchmark windows are broadcast up to so many (16 bytes each); beyond that both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000
#: White space that is no single space: most is one, and stays as it is.
BLANK = r"[\x20\x09-\x0D](?:(?<!\x20)[\x20\x09-\x0D]*|[\x20\x09-\x0D]+)"
#: Punctuation around a slot's value.
AROUND = r"""^["'(\[]+|(?:['’]s)?[.,;:!?)"'\]]*$"""
#: What counts as a unit after a number; a parameter of the template, lower case.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "inches", "feet", "miles", "pounds", "dollars", "euros", "percent", "%")


#: Spelled numbers, as they stand between words; a compound is one.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
SPELLED = rf"(?=[efhmnostEFHMNOST])(?i:(?:{'|'.join(TENS)})(?:-(?:{'|'.join(ONES[:9])}))?|{'|'.join(sorted(ONES, key=len, reverse=True))})(?![\p{{L}}\p{{N}}-])"


def squeezed(text: Column, units: tuple[str, ...] = UNITS) -> Column:
    """White space as single spaces, and one between a number and a unit that is written onto it."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " "))
    return F.regexp_replace(line, rf"(\d)(?=(?:{'|'.join(units)})[.,;!?]?(?: |$))", "$1 ")


def template(line: Column) -> Column:
    """Of a squeezed line: as many words, some of them empty (punctuation), some placeholders; <m> continues one."""
    # each step is used once, as a condition on it would compute it again; patterns are tried at each character, so they
    # begin with one that most fail at: the space before a word, also before the first
    x = F.regexp_replace(F.concat(F.lit(" "), line), rf" (?:[($€£+-]*\d[\d.,:/-]*(?:st|nd|rd|th)?|{SPELLED})", " <n>")
    x = F.regexp_replace(x, r" \p{Lu}\p{Ll}[\p{L}'-]*", " <c>")
    x = F.regexp_replace(x, rf"<n> (?:{'|'.join(map(str, UNITS))})(?=[.,;!?]?(?: |$))", "<n> <u>")
    x = F.regexp_replace(x, r"<(?:c>(?<= <c> <c>)|n>(?<= <n> <n>))(?![\p{L}\p{N}<])", "<m>")
    return F.substring(F.regexp_replace(F.lower(x), r"[\P{L}&&[^ <>\p{N}]]+", ""), 2, 2**31 - 1)


def with_words(df: DataFrame, text: str) -> DataFrame:
    """df plus __words; a text without words has one empty word."""
    return df.withColumn("__words", F.split(F.regexp_replace(template(squeezed(F.col(text))), " <m>(?![^ ])", ""), " "))


def with_values(df: DataFrame, text: str) -> DataFrame:
    """df plus __words and __raw, what stands in the text at each of them without punctuation around it."""
    line = squeezed(F.col(text))
    # stored: what the lambdas below read is not to be computed for each word again
    df = stored(df.withColumn("__all", F.split(template(line), " ")).withColumn("__line", F.split(line, " ")), "words")
    df = stored(df.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size("__all") - 1), lambda i: (i == 0) | (F.get("__all", i) != "<m>"))), "words")
    value = lambda i, k: F.array_join(F.slice("__line", i + 1, F.coalesce(F.get("__at", k + 1), F.size("__all")) - i), " ")
    raw = F.transform("__at", lambda i, k: F.regexp_replace(value(i, k), AROUND, ""))
    return df.withColumn("__raw", raw).withColumn("__words", F.transform("__at", lambda i: F.get("__all", i))).drop("__all", "__line", "__at")


def width(n: Column, share: float) -> Column:
    """Of the windows of an item of n words: with the most words changed that share allows, one run is as long."""
    need = F.ceil(F.lit(share) * n)
    return F.least(F.lit(WINDOW), F.ceil(need / (n - need + 1))).cast("int")


def hashed(words: Column, at: Column, width: int) -> Column:
    """Hash of the window of that width at a word; null beyond the end."""
    return F.when(at + width <= F.size(words), F.xxhash64(F.lit(width), *[F.get(words, at + k) for k in range(width)]))


def windows(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(k, here, hash) of each window of those widths of docs: k, __words."""
    # outer, though no text is without words: for the plain form the planner asks first whether there are any, which
    # would compute the words twice
    ours = docs.select("k", "__words", F.posexplode_outer("__words").alias("here", "__w"))
    return ours.select("k", "here", F.explode(F.array(*[hashed(F.col("__words"), F.col("here"), n) for n in widths])).alias("hash")).where("hash is not null")


def proposals(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """(k, i, shift) of equal windows; docs: k, __words, items: i, __words. A row a word and its windows stay inside
    code generation up to the join with the benchmark's hashes; only equal windows are shuffled."""
    items = items.withColumn("__width", width(F.size("__words"), share))
    widths = sorted(r[0] for r in items.select("__width").distinct().collect()) or [WINDOW]  # WINDOW rows at most
    own = F.lit(None).cast("bigint")
    for n in widths:
        own = F.when(F.col("__width") == n, hashed(F.col("__words"), F.col("there"), n)).otherwise(own)
    theirs = items.select("i", "__width", "__words", F.posexplode("__words").alias("there", "__w")).select("i", "there", own.alias("hash")).where("hash is not null")
    theirs = stored(theirs, "benchmark-windows")
    known = theirs.select("hash").distinct()
    known = F.broadcast(known) if theirs.count() <= BROADCAST_WINDOWS else known
    return windows(docs, widths).join(known, "hash", "left_semi").join(theirs, "hash").select("k", "i", (F.col("here") - F.col("there")).alias("shift")).distinct()


def slot(i: Column) -> Column:
    return F.get("iwords", i).isin("<n>", "<c>", "<u>")


def consistent(filled: Column) -> Column:
    """One b for each a."""
    return F.size(F.array_distinct(filled)) == F.size(F.array_distinct(F.transform(filled, lambda s: s["a"])))


def aligned() -> Column:
    """(n, at): the words that agree in order, less one for each word put in between, and their slots, of the best
    alignment that stays within off words of the shift. A state holds the best for each distance from the shift."""
    bands = F.sequence(F.lit(0), 2 * F.col("off"))
    mine = lambda i, b: i + F.col("shift") + b - F.col("off")
    cell = lambda n, at: F.struct(n.cast("int").alias("n"), at.cast("array<struct<i:int,j:int>>").alias("at"))

    def next_word(state: Column, i: Column) -> Column:
        def one(b: Column) -> Column:
            old, after = F.get(state, b), F.get(state, b + 1)
            hit = F.coalesce(F.get("iwords", i) == F.get("words", mine(i, b)), F.lit(False))
            met = F.when(hit & slot(i), F.concat(old["at"], F.array(F.struct(i.alias("i"), mine(i, b).alias("j"))))).otherwise(old["at"])
            # n + b: what is moved on to a later band loses the difference
            kept = cell(old["n"] + b + F.when(hit, 1).otherwise(0), met)
            return F.array_max(F.array(kept, F.when(b < 2 * F.col("off"), cell(after["n"] + b, after["at"]))))

        most = F.transform(F.array(F.transform(bands, one)), lambda c: F.transform(bands, lambda b: F.array_max(F.slice(c, 1, b + 1))))
        return F.transform(F.get(most, F.lit(0)), lambda x, b: cell(x["n"] - b, x["at"]))

    first = F.transform(bands, lambda b: cell(F.lit(0), F.array()))
    return F.array_max(F.aggregate(F.sequence(F.lit(0), F.size("iwords") - 1), first, next_word))


def leaks(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, share, slots): documents that hold an item or a re-parameterised form of it.

    Defined cases: items without words match nothing; null and empty texts hold nothing; rows without a doc_id or an
    item_id take part and give rows with a null id; repeated rows, and rows that share an id, give one result an id;
    copies of a text each get theirs; empty tables give an empty result; other columns are not read.
    """
    found = matched(docs.select(text_key(text).alias("k"), F.col(text).cast("string").alias("text")), benchmark.select(text_key("text").alias("i"), F.col("text").cast("string").alias("itext")), share)
    named = benchmark.select(text_key("text").alias("i"), "item_id").distinct()
    got = docs.select(F.col(ident).alias("doc_id"), text_key(text).alias("k")).join(found, "k").join(named, "i")
    return got.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("slots").alias("slots"))


def matched(slim: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    """(k, i, share, slots) of texts and items by their hashes, a stored table."""
    with scratch(slim.sparkSession) as work:
        return work.kept(stored(compared(slim, benchmark, share), "leaks"))


def compared(slim: DataFrame, benchmark: DataFrame, share: float) -> DataFrame:
    items = with_values(benchmark.dropDuplicates(["i"]), "itext")
    items = stored(items.where("size(__words) > 1 or __words[0] <> ''").select("i", F.col("__raw").alias("iraw"), F.col("__words").alias("iwords")), "benchmark")
    found = stored(proposals(with_words(slim, "text"), items.withColumnRenamed("iwords", "__words"), share), "proposals")
    few = slim.join(small(stored(found.select("k").distinct(), "proposed")), "k", "left_semi").dropDuplicates(["k"])
    both = with_values(few, "text").select("k", "__raw", "__words").join(found, "k").join(items, "i")
    n = F.size("iwords")
    both = both.withColumn("need", F.ceil(F.lit(share) * n).cast("int")).withColumn("off", (n - F.col("need")).cast("int"))
    low = F.greatest(F.col("shift") - F.col("off"), F.lit(0))
    part = lambda c: F.slice(c, low + 1, F.greatest(F.col("shift") + n + F.col("off") - low, F.lit(0)))
    both = stored(both.select("k", "i", "iraw", "iwords", "need", "off", part("__raw").alias("raw"), part("__words").alias("words"), (F.col("shift") - low).alias("shift")), "candidates")
    all_of = F.sequence(F.lit(0), n - 1)
    equal = F.transform(all_of, lambda i: F.coalesce(F.get("iwords", i) == F.get("words", i + F.col("shift")), F.lit(False)))
    both = both.withColumn("equal", equal).withColumn("agree", F.size(F.filter("equal", lambda e: e)))
    here = F.filter(all_of, lambda i: F.get("equal", i) & slot(i))
    filled = lambda a: F.transform(a, lambda p: F.struct(F.get("iraw", p["i"]).alias("a"), F.get("raw", p["j"]).alias("b")))
    both = both.withColumn("pairs", F.transform(here, lambda i: F.struct(i.alias("i"), (i + F.col("shift")).alias("j"))))
    both = both.withColumn("line", F.concat(F.array_join(F.transform("equal", lambda e: F.when(e, "1").otherwise("0")), ""), F.lit("0")))
    as_is = (F.col("agree") >= F.col("need")) & consistent(filled("pairs"))
    both = stored(both.withColumn("as_is", as_is), "candidates")
    # no alignment agrees in more words than stand there at all
    there = F.size(F.filter("iwords", lambda w: F.array_contains("words", w)))
    both = both.withColumn("best", F.when(~F.col("as_is") & (F.col("off") > 0) & (there >= F.col("need")), aligned()))
    both = stored(both, "candidates")
    both = both.withColumn("gaps", F.coalesce((F.col("best.n") >= F.col("need")) & consistent(filled("best.at")), F.lit(False)))
    starts = F.filter(all_of, lambda i: F.get("equal", i) & ~F.coalesce(F.get("equal", i - 1), F.lit(False)))
    end = lambda i: F.call_function("locate", F.lit("0"), F.col("line"), i + 1) - 1
    run = F.exists(starts, lambda i: (end(i) - i >= STRETCH) & consistent(filled(F.filter("pairs", lambda p: (p["i"] >= i) & (p["i"] < end(i))))))
    got = both.withColumn("run", F.contains("line", F.lit("1" * STRETCH)) & run).where("as_is or gaps or run")
    most, slots = F.when(F.col("gaps"), F.col("best.n")).otherwise(F.col("agree")), F.when(F.col("gaps"), F.size("best.at")).otherwise(F.size("pairs"))
    got = got.select("k", "i", (most / n).alias("share"), slots.alias("slots"))
    return got.groupBy("k", "i").agg(F.max("share").alias("share"), F.max("slots").alias("slots"))


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go.

    Defined cases: texts decide, so rows without an id and rows that share one are judged by themselves; null and empty
    texts stay; copies of a contaminated text go; without items all stay; the columns of docs pass through.
    """
    slim = docs.select(text_key("text").alias("k"), F.col("text").cast("string").alias("text"))
    bad = matched(slim, table(spark, sf_dir, "benchmark").select(text_key("text").alias("i"), F.col("text").cast("string").alias("itext")), SHARE)
    [key] = own_names(docs, "__key")
    return docs.withColumn(key, text_key("text")).join(bad.select(F.col("k").alias(key)).distinct(), key, "left_anti").select(*docs.columns)
