"""License scan by ordered signature rules, in DataFrame functions only.

1.  A text becomes its words, lower case, each with a blank on both sides ("CC-BY 4.0" is " cc  by  4  0 "), so that a
    pattern that begins and ends with a blank matches whole words and adjacent matches don't compete for a blank.
2.  Prefilter: one pass finds all keywords of a text, by a pattern that branches letter by letter; only the rules of the
    keywords found are tried.
3.  Detections become word intervals, from the pieces between the matches.  A detection that lies inside one of higher
    priority (or of the same priority and longer, or equal and earlier in the list) is suppressed; base phrases never
    are.  That needs one running maximum per priority over the detections of a document in order, so it is linear.

Null texts count as empty: no words, no labels, nulls for the positions.  Rows are told apart by position, so repeated
rows and null ids are reported each.  Only id and text are read; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.llm.license_rules import Rule, rules

#: the one letter beyond ASCII that would become an ASCII word of its own; any other letter does instead
_KELVIN, _OTHER = "\u212a", "\u0138"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(pattern: str) -> str:
    """A rule's pattern over words that stand between blanks of their own; optional words stay whole."""
    return f" {pattern} ".replace(" ", "  ")[1:-1]


def _words(blanks: Column) -> Column:
    """Number of words of a piece: half its blanks."""
    return ((F.length(blanks) - F.length(F.replace(blanks, F.lit(" "), F.lit("")))) / 2).cast("long")


def _branches(words: list[str]) -> str:
    """Pattern of the words, branching at each letter, so that a word of a text is told from them by a few comparisons."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])
    parts = [first + _branches(rest) for first, rest in sorted(tails.items())]
    if not parts:
        return ""
    joined = parts[0] if len(parts) == 1 and "" not in words else f"(?:{'|'.join(parts)})"
    return f"{joined}?" if "" in words else joined


def prefilter(table: list[Rule]) -> str:
    """Pattern that finds any keyword as a whole word."""
    return f" ({_branches(sorted({r.keyword for r in table}))}) "


def detections(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per detection, and one with a null label for a document without: row, id, n_words, label, priority,
    confidence, rule, start, end (words from 0, end excluded), base, suppressed."""
    table = table or rules()
    spark = docs.sparkSession
    plain = F.replace(F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(_KELVIN), F.lit(_OTHER))
    text = F.concat(F.lit("."), F.lower(plain), F.lit("."))
    normal = docs.select(F.col(id_column).alias("id"), F.regexp_replace(text, _NO_WORD, "  ").alias("wide")).select(
        F.monotonically_increasing_id().alias("row"), "id", F.expr("substring(wide, 2, length(wide) - 2)").alias("norm")
    )
    listed = F.array(
        *(
            F.struct(F.lit(i).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(spaced(r.pattern)).alias("pattern"))
            for i, r in enumerate(table)
        )
    )

    def matches(rule: Column) -> Column:
        pieces = F.split(F.col("norm"), rule["pattern"], -1)
        parts = F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all("norm", rule["pattern"], F.lit(0)).alias("hit"))
        found = F.filter(parts, lambda x: x["hit"].isNotNull())
        return F.transform(
            found,
            lambda x, k: F.struct(
                rule["rule"].alias("rule"), k.alias("k"), _words(x["piece"]).alias("gap"), _words(x["hit"]).alias("width")
            ),
        )

    keywords = F.array_distinct(F.regexp_extract_all("norm", F.lit(prefilter(table)), F.lit(1)))
    # used twice below, so the keywords of a text are looked for once
    normal = normal.select("row", "id", "norm", keywords.alias("keywords"))
    chosen = F.filter(listed, lambda r: F.array_contains(F.col("keywords"), r["keyword"]))
    hits = F.when(F.size("keywords") > 0, F.flatten(F.transform(chosen, matches)))
    rows = normal.select("row", "id", _words(F.col("norm")).alias("n_words"), hits.alias("hits"))
    rows = rows.select("row", "id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "id", "n_words", "hit.*")
    facts = spark.createDataFrame(
        [(i, r.label, r.priority, r.confidence) for i, r in enumerate(table)],
        "rule int, label string, priority int, confidence double",
    )
    # the rule list is a fixed table of a few hundred rows
    rows = rows.join(F.broadcast(facts), "rule", "left").repartition("row")
    before = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(before))
    placed = placed.withColumn("start", F.col("end") - F.col("width")).withColumn("base", F.col("priority") == 0)
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in table} - {0})
    covered = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(earlier)
        covered |= (F.col("priority") == level) & F.coalesce(reach >= F.col("end"), F.lit(False))
    # of equal intervals a later row of the order has no higher priority, so earlier rows are all that can cover one
    return placed.select(
        "row", "id", "n_words", "label", "priority", "confidence", "rule", "start", "end", "base",
        F.when(F.col("label").isNotNull(), ~F.col("base") & covered).alias("suppressed"),
    )


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_suppressed."""
    found = detections(docs, id_column=id_column, text_column=text_column, table=table)
    stays = F.col("label").isNotNull() & ~F.col("suppressed")
    base = F.col("base") & F.col("label").isNotNull()
    joined = lambda condition: F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")
    return found.groupBy("row").agg(
        F.first("id").alias(id_column),
        F.first("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(stays).alias("labels"),
        F.coalesce(F.max(F.when(stays, F.col("confidence"))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("suppressed"), 1)).alias("n_suppressed"),
    ).drop("row")
