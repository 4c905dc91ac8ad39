"""Benchmark decontamination on templates: numbers, names and units as typed slots, checked for consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Words of a window, and the share of an item's windows that a document must have.
WINDOW, COVERED = 5, 0.8
#: Literal words that a window needs, so that runs of slots alone match nothing.
LITERALS = 3
#: Views of a text: names as slots, names as literal words, and all words as they are.
SLOTS, NAMED, EXACT = 0, 1, 2
#: Bits of the map that says which windows a benchmark has; more windows only let more through to the join.
MAP_BITS = 1 << 19
#: Units that may follow a number.
UNITS = "km|cm|mm|m|mi|miles?|inch(?:es)?|feet|ft|kg|mg|g|lbs?|oz|tons?|l|ml|liters?|litres?|hours?|hrs?|h|minutes?|min|seconds?|sec|s|days?|weeks?|months?|years?|mph|kmh|dollars?|cents?|euros?|pounds?|percent|degrees?"

NUMBER, UNIT, NAME = "\u0001n", "\u0001u", "\u0001p"
#: Words that are no names, though they begin sentences.
COMMON = (
    "A|About|After|All|Although|Also|An|And|Another|Any|Are|As|At|Because|Before|Both|But|By|Can|Could|Did|Do|Does|During|Each|Every|Find|First|For|From|Given|Had|Has|Have|He|Her|Here|His|How|However|"
    "If|In|Into|Is|It|Its|Let|Many|More|Most|Much|My|Next|No|Not|Now|Of|On|One|Or|Other|Our|Out|Over|She|Should|Since|So|Some|Suppose|Than|That|The|Their|Then|There|These|They|This|Those|To|Two|Under|"
    "Until|Was|We|Were|What|When|Where|Which|While|Who|Whose|Why|Will|With|Would|You|Your|Aber|Als|Auf|Aus|Das|Dem|Den|Der|Des|Die|Ein|Eine|Er|Es|Für|Ich|Im|Ist|Mit|Nach|Sie|Sind|Und|Von|War|Was|Wenn|Wer|"
    "Wie|Wir|Wo|Zu|Au|Aux|Avec|Ce|Ces|Cette|Comme|Dans|De|Du|Elle|En|Est|Et|Il|Ils|Je|La|Le|Les|Mais|Nous|Ou|Par|Pas|Pour|Que|Quel|Quelle|Qui|Sa|Se|Si|Son|Sont|Sur|Un|Une|Vous|Al|Como|Con|Cuando|"
    "Cuál|Cuánto|Cuántos|Del|Donde|El|Ella|Ellos|Las|Lo|Los|No|Para|Pero|Por|Porque|Qué|Ser|Sin|Su|Sus|Una|Uno|Y|Yo"
)


def one_of(words: str) -> str:
    """A pattern for any of the words parted by ``|``, which looks at their first letters first."""
    by_letter: dict[str, list[str]] = {}
    for word in dict.fromkeys(words.split("|")):
        by_letter.setdefault(word[0], []).append(word[1:])
    return "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())


# Patterns begin with the letter that they need, since most places of a text then cost a look at one letter only. Groups of varying length
# are repeated possessively, which Java runs as a loop: a greedy one takes a stack frame for each repeat and ends the JVM on long rows of names or numbers.
GAP = r"(?=\s)[^\S\n]*\n?[^\S\n]*"
CAPITAL = rf"(?=\p{{Lu}})(?!(?:{one_of(COMMON)})(?![\p{{L}}\p{{N}}]))\p{{Lu}}\p{{Ll}}+(?:\p{{Lu}}\p{{Ll}}+)*+(?![\p{{L}}\p{{N}}])"
INITIAL = rf"(?:\.(?:{GAP})?|['’])"
PART = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:({CAPITAL})(?:-|{GAP})|(Mrs?|Ms|Dr|Prof|St)\.{GAP}|(\p{{Lu}}){INITIAL})"
#: Marks: of a slot, between the names of one slot, between a text's views, and for the points and commas in numbers.
SLOT, JOIN, PART_END, POINT = "\u0001", "\u0002", "\u0003", "\u0004"
SPLIT = r"[^\p{L}\p{N}\u0001\u0002\u0004%€$£]++"


def slotted(text: Column) -> Column:
    """The lower-case text with slots: each is one word that begins with its mark, what fills it after that.

    Slots are numbers, a unit after a number, and names: capitalised words that are not common, wherever they stand.
    Names in a row, over a hyphen or a line's end too, with their titles and initials, are one word, parted by U+0002.
    """
    plain = F.coalesce(text, F.lit(""))
    for mark in (SLOT, JOIN, PART_END, POINT):
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    numbers = F.regexp_replace(plain, r"\p{Nd}(?<![\p{L}\p{N}]\p{Nd})\p{Nd}*+(?:[.,]\p{Nd}++(?![\p{L}\p{N}]))*+(?![\p{L}\p{N}])", f" {NUMBER}$0 ")
    units = F.regexp_replace(numbers, rf"({NUMBER}\S+\s+)((?i:{UNITS})|[%€$£])(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 ")
    points = F.regexp_replace(units, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", POINT)
    joined = F.regexp_replace(points, rf"{PART}(?=(?:\p{{Lu}}{INITIAL}){{0,3}}{CAPITAL})", "$1$2$3\u0002")
    return F.lower(F.regexp_replace(joined, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}\u0002])(?:\p{{Lu}}\p{{Ll}}*+\u0002)*+{CAPITAL}", f"{NAME}$0"))


def words_of(marked: Column) -> Column:
    """Array of a slotted text's words. Numbers keep a mark for points and commas; what is neither letter, digit nor mark parts words."""
    return F.array_remove(F.split(marked, SPLIT), "")


def kind(word: Column) -> Column:
    """A literal word, or just the mark of a slot."""
    return F.when(word.startswith("\u0001"), F.substring(word, 1, 2)).otherwise(word)


def named(words: Column) -> Column:
    """The words with those of names as literal ones, so that names match in any case."""
    return F.flatten(F.transform(words, lambda w: F.when(w.startswith(NAME), F.split(F.substring(w, len(NAME) + 1, 1 << 30), JOIN)).otherwise(F.array(w))))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text, null texts like empty ones."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def windows(texts: DataFrame, *, keep: Column | None = None, exact: tuple[int, ...] = tuple(range(1, WINDOW + 1))) -> DataFrame:
    """(key, view, at, of, hash, words): the windows of the template words of ``texts`` (key, text).

    Windows of the views SLOTS and NAMED have WINDOW words and literals enough; those of the view EXACT have as many words as ``exact``
    lists and are hashed with what fills their slots. ``of`` is the view's number of words.
    ``keep`` is an array of 64-bit pieces of a bit map; only windows whose bit is set stay.
    Each text's words are laid beside themselves, shifted, and exploded, so that hashing and screening are compiled code over rows.
    """
    marked = texts.select("key", slotted(F.col("text")).alias("marked"))
    split = marked.select("key", F.col("marked").contains(NAME).alias("names"), words_of(F.col("marked")).alias("slots"))
    split = split.select("key", "slots", F.when(F.col("names"), named(F.col("slots"))).alias("named"))
    # Both views in a row, a mark of its own between them; without names they are the same.
    both = F.concat("slots", F.array(F.lit(PART_END)), "named")
    laid = split.select("key", F.size("slots").alias("n"), F.coalesce(F.size("named"), F.lit(-1)).alias("m"), F.coalesce(both, F.col("slots")).alias("w"))
    shifted = F.arrays_zip(*[F.col("w") if i == 0 else F.slice("w", i + 1, F.size("w")) for i in range(WINDOW)])
    # An outer explode, since Spark would filter by the size of the array before a plain one and make the array twice.
    rows = laid.select("key", "n", "m", F.posexplode_outer(shifted).alias("pos", "z"))
    w = [F.col("z")[str(i) if i else "w"] for i in range(WINDOW)]
    rows = rows.select("key", "n", "m", "pos", *[x.alias(f"w{i}") for i, x in enumerate(w)])
    w = [F.col(f"w{i}") for i in range(WINDOW)]

    def kept(hash: Column) -> Column:
        if keep is None:
            return F.lit(True)
        slot = F.pmod(hash, F.lit(MAP_BITS))
        return F.getbit(F.get(keep, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

    def whole(width: int) -> Column:
        # Positions n - width + 1 .. n have the mark between the views among their words.
        return w[width - 1].isNotNull() & ~F.col("pos").between(F.col("n") - width + 1, F.col("n"))

    literals = sum((F.when(x.startswith("\u0001"), 0).otherwise(1) for x in w), F.lit(0))
    # With the partition's number in the filter, hashes are computed before it and once; Spark would else copy them into it at each use.
    hashed = rows.withColumn("here", F.spark_partition_id()).withColumn("h", F.xxhash64(*map(kind, w)))
    for width in exact:
        hashed = hashed.withColumn(f"e{width}", F.xxhash64(F.lit(width), *w[:width]))
    found = {"h": kept(F.col("h")) & whole(WINDOW) & (literals >= LITERALS)} | {f"e{k}": kept(F.col(f"e{k}")) & whole(k) for k in exact}
    any_found = F.lit(False)
    for condition in found.values():
        any_found = any_found | condition
    second = F.col("pos") > F.col("n")
    # Of a text with names, the first part shows the view SLOTS and the second the others; of one without, each row shows all views.
    made = lambda view, hash, width: F.struct(F.lit(view).alias("view"), F.col(hash).alias("hash"), F.array(*w[:width]).alias("words"))
    shows = [F.when(found["h"] & (~second if view == SLOTS else second | (F.col("m") < 0)), made(view, "h", WINDOW)) for view in (SLOTS, NAMED)]
    shows += [F.when(found[f"e{k}"] & (second | (F.col("m") < 0)), made(EXACT, f"e{k}", k)) for k in exact]
    at = F.when(second, F.col("pos") - F.col("n") - 1).otherwise(F.col("pos"))
    of = F.when(second, F.col("m")).otherwise(F.col("n"))
    out = hashed.where(any_found & (F.col("here") >= 0)).select("key", at.alias("at"), of.alias("of"), F.explode(F.array_compact(F.array(*shows))).alias("s"))
    return out.select("key", "s.view", "at", "of", "s.hash", "s.words")


def bit_map(hashes: DataFrame) -> Column:
    """A constant array of MAP_BITS bits with those of the hashes set: of one size, however many hashes there are."""
    slot = F.pmod("hash", F.lit(MAP_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(hash, {MAP_BITS}) % 64 as int))").alias("bit")
    rows = hashes.select(F.floor(slot / 64).cast("int").alias("piece"), bit).groupBy("piece").agg(F.bit_or("bit").alias("bits"))
    bits = {r.piece: r.bits for r in rows.collect()}  # MAP_BITS / 64 rows at most
    told = ",".join(str(bits.get(i, 0)) for i in range(MAP_BITS // 64))  # one string: a literal for each number is slow to plan
    return F.split(F.lit(told), ",").cast("array<bigint>")


def text_matches(texts: DataFrame, items: DataFrame, covered: float = COVERED) -> DataFrame:
    """(key, item, item_windows, matched_windows, coverage, slots, refilled) for each different text and item that it contains.

    ``texts`` and ``items`` are (key, text) with the ``text_key`` of the text; ``item`` is the item's key.

    A pair is looked at only if it shares one of the item's rarest windows: so many that a text which has none of them lacks more of
    the item than ``covered`` allows. A window that very many items share thus makes no pairs of all texts and all items that have it.
    """
    listed = windows(items.dropDuplicates(["key"]))
    templates = listed.where(F.col("view") != EXACT)
    # Items without any such window, being short or mostly slots, are compared word by word.
    small = listed.where(F.col("view") == EXACT).join(templates.select("key").distinct(), "key", "left_anti")
    small = small.where(F.size("words") == F.least(F.col("of"), F.lit(WINDOW)))
    of_items = cut(templates.unionByName(small).select(F.col("key").alias("item"), "view", F.col("at").alias("item_at"), "of", "hash", F.col("words").alias("item_words")))
    widths = sorted(r.n for r in of_items.where(F.col("view") == EXACT).select(F.size("item_words").alias("n")).distinct().collect())  # WINDOW at most

    different = of_items.select("item", "view", "hash").distinct()
    common = different.groupBy("view", "hash").agg(F.count("*").alias("items"))
    ranked = different.join(common, ["view", "hash"])
    per_item = Window.partitionBy("item", "view")
    ranked = ranked.withColumn("item_windows", F.count("*").over(per_item)).withColumn("rank", F.row_number().over(per_item.orderBy("items", "hash")))
    ranked = cut(ranked.select("item", "view", "hash", "item_windows", (F.col("rank") <= F.col("item_windows") - F.ceil(F.col("item_windows") * covered - 1e-9) + 1).alias("rare")))

    screened = windows(texts, keep=bit_map(of_items.select("hash")), exact=tuple(widths))
    of_texts = cut(screened.drop("of").distinct())  # copies of a text are one
    pairs = of_texts.select("key", "view", "hash").distinct().join(ranked.where("rare").select("item", "view", "hash"), ["view", "hash"]).select("key", "item", "view").distinct()
    met = of_texts.join(cut(pairs), ["key", "view"]).join(of_items, ["item", "view", "hash"])
    met = met.where(F.transform("words", kind) == F.transform("item_words", kind))
    met = cut(met.select("key", "item", "view", "hash", (F.col("at") - F.col("item_at")).alias("shift"), "item_at", "of", "words", "item_words"))

    aligned_by = ["key", "item", "view", "shift"]
    ends = lambda i: (F.col("item_at") + i == 0) | (F.col("item_at") + i == F.col("of") - 1)
    zipped = F.transform(F.arrays_zip("item_words", "words"), lambda p, i: F.struct(p["item_words"].alias("mine"), p["words"].alias("theirs"), ends(i).alias("end")))
    filled = F.filter(zipped, lambda p: p["mine"].startswith("\u0001") & ~(p["end"] & p["theirs"].contains("\u0002")))
    filled = met.select(*aligned_by, F.explode(filled).alias("p")).select(*aligned_by, "p.mine", "p.theirs").distinct()
    fillings = filled.groupBy(*aligned_by).agg(
        F.count("*").alias("pairs"), F.countDistinct("mine").alias("slots"), F.count_if(F.col("mine") != F.col("theirs")).alias("refilled")
    )
    aligned = met.select(*aligned_by, "hash").distinct().join(fillings, aligned_by, "left")
    consistent = aligned.where("pairs is null or pairs = slots")
    found = consistent.groupBy("key", "item", "view", "hash").agg(F.max("slots").alias("slots"), F.min("refilled").alias("refilled"))
    counted = found.groupBy("key", "item", "view").agg(
        F.count("*").alias("matched_windows"), F.coalesce(F.max("slots"), F.lit(0)).alias("slots"), F.coalesce(F.max("refilled"), F.lit(0)).alias("refilled")
    )
    totals = ranked.select("item", "view", "item_windows").distinct()
    share = F.col("matched_windows") / F.col("item_windows")
    enough = counted.join(totals, ["item", "view"]).withColumn("coverage", share).where(F.col("coverage") >= covered)
    columns = ["item_windows", "matched_windows", "coverage", "slots", "refilled"]
    best = F.max_by(F.struct(*columns), F.struct("coverage", -F.col("view"))).alias("b")
    return enough.groupBy("key", "item").agg(best).select("key", "item", *[f"b.{c}" for c in columns])


def matches(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", covered: float = COVERED
) -> DataFrame:
    """(doc_id, item_id, item_windows, matched_windows, coverage, slots, refilled) for each item that a document contains.

    A document contains an item if, with names as slots or with names as literal words, it has at least ``covered`` of
    the item's different template windows, counting those on alignments whose slots are consistent only: on one alignment
    of document and item, the same filling of a slot in the item always
    meets the same filling in the document. A name at the item's ends may have run into names around the copy there, so
    a name of several words is not held against it. The row is that of the better view. ``slots`` are the item's fillings met and ``refilled``
    how many of them differ in the document: above 0 for re-parameterised copies, 0 for verbatim ones.
    Items without a window, since they have fewer than five words or hardly any literal ones, are looked for as they stand, fillings and all;
    items without words match nothing.
    A map of fixed size of the benchmark's windows screens the documents' windows where they are made; only what
    passes is shuffled for the exact join. Null texts are empty. Verdicts are by text, so rows with a null or a repeated id lose nothing: an
    id's row for an item is the best of its texts'. Repeated rows on either side give one row. No rows on a side give none.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", text_key(F.col("text")).alias("key"), "text")
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).select("item_id", text_key(F.col("text")).alias("key"), "text")
    found = cut(text_matches(keyed.select("key", "text"), items.select("key", "text"), covered))
    named = found.join(items.select("item_id", F.col("key").alias("item")).distinct(), "item").drop("item")
    rows = keyed.select("doc_id", "key").join(named, "key").drop("key")
    columns = ["item_windows", "matched_windows", "coverage", "slots", "refilled"]
    best = F.max(F.struct("coverage", *[c for c in columns if c != "coverage"])).alias("b")
    return rows.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", *[f"b.{c}" for c in columns])


def op8_template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``matches`` of all ``documents`` with all items of ``benchmark``."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
