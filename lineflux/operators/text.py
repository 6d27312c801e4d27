"""Line-log parsing, translation, name mining and dictionary look-ups."""

from __future__ import annotations

import re
from functools import reduce
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import PERIOD_S, clock_seconds
from ..functions.windows import UP_TO
from ..shipping import ship

#: Fixed line formats of a play log.
TIME, SCORE, DELTA, QUARTER = r"^(?:[0-9]{1,2}:[0-9]{2}|--:--)$", r"^[0-9]+ - [0-9]+$", r"^\+[0-9]+$", r"^Q([0-9]+) (?:start|end)$"


def parse_log(docs: DataFrame, doc: str, text: str, made: str = "made", left_first: bool = False) -> DataFrame:
    """(doc, seq, quarter, elapsed_s, body, delta, points) of newest-first line logs.

    A time line opens a record, a score line is skipped, a delta line overwrites the record's delta, other lines are its texts. Records are
    read backwards, texts within a record forwards; a start marker sets the quarter of what follows. Points count only where
    the text says so. A page shows the left team's text before its clock: read line by line it falls to the record above, which is the
    default; with left_first a text that stands directly before a clock belongs to that clock's record.
    """
    lines = docs.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    line = F.col("line")
    kind = F.when(line.rlike(QUARTER), "quarter").when(line.rlike(TIME), "time").when(line.rlike(SCORE), "score").when(line.rlike(DELTA), "delta").otherwise("text")
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(*UP_TO)
    lines = lines.withColumn("kind", kind).withColumn("rec", F.sum((F.col("kind") == "time").cast("int")).over(w))
    if left_first:
        ahead = Window.partitionBy(doc).orderBy("pos")
        own = (F.col("kind") == "text") & (F.coalesce(F.lag("kind").over(ahead), F.lit("score")) == "score") & F.coalesce(F.lead("kind").over(ahead), F.lit("")).isin("time", "delta")
        lines = lines.withColumn("_own", own).withColumn("rec", F.col("rec") + (F.col("_own") | ((F.col("kind") == "delta") & F.coalesce(F.lag("_own").over(ahead), F.lit(False)))).cast("int"))
    lines = lines.where("rec > 0")
    heads = lines.groupBy(doc, "rec").agg(
        F.max(F.when(F.col("kind") == "time", line)).alias("clock"),
        F.max_by(F.when(F.col("kind") == "delta", F.substring(line, 2, 9).cast("int")), F.when(F.col("kind") == "delta", F.col("pos"))).alias("delta"),
    )
    rows = lines.where(F.col("kind").isin("text", "quarter")).join(heads, [doc, "rec"])
    back = Window.partitionBy(doc).orderBy(F.desc("rec"), "pos").rowsBetween(*UP_TO)
    rows = rows.withColumn("quarter", F.coalesce(F.last(F.when((F.col("kind") == "quarter") & line.endswith("start"), F.regexp_extract(line, QUARTER, 1).cast("int")), True).over(back), F.lit(1)))
    rows = rows.where("kind = 'text'").withColumn("seq", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("rec"), "pos")))
    base = (F.col("quarter") - 1) * PERIOD_S
    return rows.select(doc, "seq", "quarter", (base + PERIOD_S - clock_seconds(F.col("clock"))).cast("long").alias("elapsed_s"), line.alias("body"), "delta", F.when(F.contains(line, F.lit(made)), F.coalesce("delta", F.lit(0))).otherwise(0).alias("points"))


def replaced(text: Column, table: dict[str, str], after: str = "") -> Column:
    """Each key by its value and `after`, longest key first."""
    for k in sorted(table, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(k), F.lit(table[k] + after))
    return text


def translated(text: Column, phrases: dict[str, str], names: dict[str, str] | None = None, markers: dict[str, str] | None = None, after: str = "") -> Column:
    """A line with its markers (regular expression to replacement, which may name groups), then names, then phrases replaced, the last two longest
    first and a phrase followed by `after`; runs of spaces collapse."""
    for regex, value in (markers or {}).items():
        text = F.regexp_replace(text, regex, value)
    text = replaced(replaced(text, names or {}), phrases, after)
    return F.trim(F.regexp_replace(text, " +", " "))


SPACES = re.compile("  +")
#: Entries of a dictionary that is broadcast, and their characters.
ENTRIES, ENTRY_CHARACTERS = 1_000_000, 1 << 26


def entries(table: DataFrame, key: str, value: str) -> list[tuple[str, str]]:
    """A dictionary's entries in the order in which they replace: longest key first. Its size is checked. Of several values the greatest counts;
    empty and null keys are left out, and a null value is empty."""
    t = table.where(F.col(key) != "").groupBy(F.col(key).alias("k")).agg(F.coalesce(F.max(value), F.lit("")).alias("v"))
    n, size = t.agg(F.count("*"), F.coalesce(F.sum(F.length("k") + F.length("v")), F.lit(0))).first()
    if n > ENTRIES or size > ENTRY_CHARACTERS:
        raise ValueError(f"a dictionary of {n} entries and {size} characters is too large to broadcast")
    return sorted(((r.k, r.v) for r in t.collect()), key=lambda x: (-len(x[0]), x[0]))


#: Pieces of texts whose translation a worker keeps, and their longest.
PIECES, PIECE = 1 << 17, 64


def replace_in_order(text: str, finder, order: list[tuple[str, str]], longest: int) -> str:
    """Each entry in order, as replacing all of them would, but only those that the text holds by then are touched. The text is searched once;
    after a replacement only what touches the new values is, since nothing else can have come up."""
    ahead = list({i for _, i in finder.iter(text)})
    heapify(ahead)
    known = set(ahead)
    while ahead:
        key, value = order[i := heappop(ahead)]
        parts = text.split(key)
        if len(parts) == 1:
            continue
        text, at = value.join(parts), 0
        for part in parts[:-1]:
            at += len(part)
            for _, j in finder.iter(text, max(at - longest + 1, 0), min(at + len(value) + longest - 1, len(text))):
                if j > i and j not in known:
                    known.add(j)
                    heappush(ahead, j)
            at += len(value)
    return text


def replacer(order: list[tuple[str, str]]):
    """A function that replaces the entries in a text, one after the other.

    No entry reaches beyond a run of characters that entries are made of, so each run, at least as long as the shortest entry, is worked out by
    itself, and short ones, which recur, are kept."""
    import ahocorasick

    finder = ahocorasick.Automaton()
    for i, (k, _) in enumerate(order):
        finder.add_word(k, i)
    finder.make_automaton()
    longest, shortest = len(order[0][0]), len(order[-1][0])
    runs = re.compile("[%s]{%d,}" % ("".join(map(re.escape, sorted({c for k, _ in order for c in k}))), shortest))
    kept: dict[str, str] = {}

    def translated_run(m):
        run = m.group()
        out = kept.get(run)
        if out is None:
            out = replace_in_order(run, finder, order, longest)
            if len(run) <= PIECE:
                if len(kept) >= PIECES:
                    kept.clear()
                kept[run] = out
        return out

    return lambda text: runs.sub(translated_run, text)


def translated_by(lines: DataFrame, text: str, tables: list[list[tuple[str, str]]]) -> DataFrame:
    """lines with text translated by dictionaries (entries()), one after the other; runs of spaces collapse. A null text stays.

    The entries go out once and are found by an automaton, so a line's cost does not grow with the dictionary and the plan doesn't either. A long
    line takes a search of its text and one around each replacement."""
    ship(lines.sparkSession)
    sc = lines.sparkSession.sparkContext
    known = sc.broadcast(tables)

    def rows(batches):
        import pyarrow as pa

        replacers = [replacer(order) for order in known.value if order]
        for batch in batches:
            at, out = batch.schema.get_field_index(text), []
            for t in batch.column(at).to_pylist():
                for f in replacers:
                    t = f(t) if t else t
                out.append(t if t is None else SPACES.sub(" ", t).strip(" "))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return lines.mapInArrow(rows, lines.schema)


def by_line(text: Column, f) -> Column:
    """f on every line of a text."""
    return F.array_join(F.transform(F.split(text, "\n"), f), "\n")


def mined_names(docs: DataFrame, text: str, keywords: str | list[str], *, prefixes: tuple[str, ...] = (), mark: str | None = None, banned: str = "[0-9]") -> DataFrame:
    """Distinct words of 2 to 6 letters before the first space or hyphen of lines with a keyword, and their number of lines.

    Left out: words that begin with a prefix (what teams do), lines with the mark among their first six letters, and words with a banned
    character."""
    lines = docs.select(F.explode(F.split(text, "\n")).alias("line"))
    has = [F.contains("line", F.lit(k)) for k in ([keywords] if isinstance(keywords, str) else keywords)]
    lines = lines.where(reduce(lambda a, b: a | b, has)).select(F.trim("line").alias("line"))
    lines = lines.withColumn("name", F.regexp_extract("line", "^([^ -]+)", 1)).where(F.length("name").between(2, 6) & ~F.col("name").rlike(banned))
    for p in prefixes:
        lines = lines.where(~F.startswith("name", F.lit(p)))
    if mark is not None:
        lines = lines.where(~F.contains(F.substring("line", 1, 6), F.lit(mark)))
    return lines.groupBy("name").agg(F.count("*").alias("n_lines"))


def classified(rows: DataFrame, keys: list[str], text: str, points: str, rules: list[tuple[list[str], str]], shots: dict[str, tuple[str, int]], made: list[str], missed: list[str], ignored: list[str]) -> DataFrame:
    """Counters by key of what texts say, the first rule that fits deciding.

    A text with an ignored word counts nowhere. rules: words, and the counter that they raise. Other texts count only if they say made or
    missed: shots gives, in order, each word's counter and its points where the row has none. Returns keys, pts, the rules' counters, and _m
    and _a (made, attempted) of each shot."""
    t = F.col(text)
    says = lambda words: reduce(lambda a, b: a | b, (F.contains(t, F.lit(w)) for w in words))
    kind = F.when(says(ignored), F.lit(None).cast("string"))
    for words, name in rules:
        kind = kind.when(says(words), name)
    hit, miss = says(made), says(missed)
    for word, (name, _) in shots.items():
        kind = kind.when((hit | miss) & F.contains(t, F.lit(word)), name)
    r = rows.withColumn("_kind", kind).withColumn("_made", hit)
    given = F.when(F.col(points) > 0, F.col(points))
    worth = F.lit(0)
    for name, value in shots.values():
        worth = F.when((F.col("_kind") == name) & F.col("_made"), F.coalesce(given, F.lit(value))).otherwise(worth)
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    sums = [count(F.col("_kind") == n, n) for n in dict.fromkeys(n for _, n in rules)]
    for name, _ in dict.fromkeys(shots.values()):
        sums += [count((F.col("_kind") == name) & F.col("_made"), f"{name}_m"), count(F.col("_kind") == name, f"{name}_a")]
    return r.groupBy(*keys).agg(F.sum(worth).cast("long").alias("pts"), *sums)


def prefix_lookup(lines: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """The longest name that is the line or its beginning up to a space. Word prefixes are joined by equality."""
    words = F.split(text, " ")
    prefixes = lines.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))).alias(name))
    hit = prefixes.join(names.select(name).distinct(), name).groupBy(key).agg(F.max_by(name, F.length(name)).alias(name))
    return lines.select(key).join(hit, key, "left")


def merged_dictionary(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Existing values stay, new keys come in, stale keys are kept; an empty value counts as none."""
    j = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full_outer")
    return j.select(key, F.coalesce(F.nullif("_old", F.lit("")), F.col("_new"), F.lit("")).alias(value))
