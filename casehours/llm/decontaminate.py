"""Benchmark decontamination by template canonicalisation, in DataFrame functions alone.

Texts and benchmark items become sequences of tokens in which numbers (digits or words), names and units (after a number)
are typed placeholders. A name is a capitalised word inside a sentence, and the same word where it begins one. A value of
several words is one token: number words in a row (twenty-one), groups of three digits (1 200), names in a row (Mary Ann). Windows of
``WINDOW`` placeholders and literal words are hashed and joined, and literal words of windows that meet are compared.
Windows of a document that lie on one alignment with an item belong together. Windows without slots or with equal values
count by themselves. A name of the item must map to one name of the document: where it meets two, the windows with it do
not count unless their values are equal. Equal numbers and units can stand for two things, so they may map to two, but then every
window of the item that can be found must be there; where some are missing, the windows with such a number do not count unless their values are
equal. ``consistent`` says that no value of the item meets two. If all values of an alignment are an item's, it is a
verbatim copy, else a re-parameterised one.

A template is no evidence where it has few words. So windows with fewer than ``LITERALS`` different literal words, and
items shorter than a window, are searched with their values, word for word; items of one or two tokens count only where
they are the whole document.

Items of one template with the same pattern of equal values are one class, so that documents meet a template once,
however many items it has. A document is contaminated by a class if an alignment has ``NEED`` windows or half of the
item's, whichever is less.

Defined results: null and empty texts and items have no tokens and match nothing; rows with a null id are reported with
that null id; rows that share an id are one document; empty tables give an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casehours.llm.common import ROW, cut, settled, sized, with_row_ids, without_row_ids

WINDOW, LITERALS, NEED = 8, 5, 6
#: Tokens of an item that is searched inside documents.
LEAST_INSIDE = 3

#: Windows of a benchmark that may be broadcast (about 60 bytes each); beyond that the join shuffles.
BROADCAST_WINDOWS = 300_000

#: The units that are placeholders after a number.
UNITS = "km mm cm kg mg ml kWh MWh mph km/h hours hour minutes minute seconds second days day weeks week months month years year meters meter metres metre miles mile feet foot inches inch dollars dollar euros euro cents cent percent litres liters grams tons pounds m g l s h t %".split()

#: Words that are numbers, in English, German, French and Spanish. (Those for one are left out, as mostly they are none, and "elf" and "once", which are words of English.)
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()

#: Marks inside a token of several words: of numbers, and of names.
NUMBERS_JOINED, NAMES_JOINED = "\u0005", "\u0006"

#: What lies between groups of digits, and between names: the match itself comes first, what stands before it is asked then.
_IN_GROUPS = r"[ \u00A0\u2009\u202F](?=\p{Nd}{3}(?![\p{L}\p{N}]))(?<=(?<![\p{L}\p{N}.,:/])\p{Nd}{1,3}[ \u00A0\u2009\u202F])"
_IN_NAME = r"\s\u0002(?=\p{Lu})(?<=\u0002\p{Lu}\p{Ll}{1,40}\s\u0002)"

_UNIT = r"(\p{Nd}\s?)(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
_NAME = r"(?<=[\p{Ll}\p{Nd},;:)]\s)(\p{Lu}\p{Ll}+)"
_FIRST = r"(^|[.!?]['\")\]]{0,2}\s+|[\r\n]\s*)(\p{Lu}\p{Ll}+)"
_TOKEN = r"[\u0002\u0003\u0004]?\p{L}[\p{L}\p{M}\p{N}\u0005\u0006]*|\u0003%|\p{Nd}+(?:[.,:/\u0005]\p{Nd}+)*"
NUMBER, NAME, UNIT, FIRST = 1, 2, 3, 4


def tokens(text: Column) -> Column:
    """Lower-case tokens; a name begins with U+0002, a unit with U+0003, a capitalised word that begins a sentence with U+0004."""
    marked = F.regexp_replace(F.regexp_replace(text, _IN_GROUPS, NUMBERS_JOINED), _UNIT, "$1 \u0003$2")
    marked = F.regexp_replace(F.regexp_replace(marked, _NAME, "\u0002$1"), _IN_NAME, NAMES_JOINED)
    marked = F.regexp_replace(marked, _FIRST, "$1\u0004$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), 0)


def numbers_joined(words: Column) -> Column:
    """``words`` with number words in a row as one; "one" counts after another."""
    counts = lambda x: x.isin(NUMBER_WORDS)

    def joined(flags: Column) -> Column:
        def put(x: Column, k: Column) -> Column:
            after = F.slice(flags, k + 1, F.size(flags))
            length = F.coalesce(F.nullif(F.array_position(after, F.lit(False)), F.lit(0)) - 1, F.size(after)).cast("int")
            first = ~F.coalesce(F.get(flags, k - 1), F.lit(False))
            return F.when(~F.get(flags, k), x).when(first, F.array_join(F.slice(words, k + 1, length), NUMBERS_JOINED))

        return F.filter(F.transform(words, put), lambda x: x.isNotNull())

    flags = F.transform(words, lambda x, k: counts(x) | ((x == "one") & F.coalesce(counts(F.get(words, k - 1)), F.lit(False))))
    return F.when(F.exists(words, counts), F.get(F.transform(F.array(flags), joined), F.lit(0))).otherwise(words)


def symbol(token: Column) -> Column:
    """1 for a number, 2 for a name, 3 for a unit, else a hash of the word."""
    code = F.ascii(token)
    number = code.between(48, 57) | token.isin(NUMBER_WORDS) | token.contains(NUMBERS_JOINED)
    return F.when(number, F.lit(NUMBER).cast("long")).when(code.isin(NAME, UNIT), code.cast("long")).otherwise(F.xxhash64(token))


def tokenised(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text) with columns words (tokens) and symbols."""
    marked = rows.select("key", tokens(F.coalesce("text", F.lit(""))).alias("marked"))
    inside = F.transform(F.filter("marked", lambda x: F.ascii(x) == NAME), lambda x: F.substring(x, 2, 1 << 30))
    first = F.transform(F.filter("marked", lambda x: F.ascii(x) == FIRST), lambda x: F.substring(x, 2, 1 << 30))
    named = marked.select("key", "marked", F.array_intersect(first, inside).alias("names"))  # names that begin a sentence as well
    plain = lambda x: F.substring(x, 2, 1 << 30)
    # two references to the names: with one alone, Spark would move their computation into the lambda
    own = lambda x: F.when((F.size("names") > 0) & F.array_contains("names", plain(x)), F.concat(F.lit("\u0002"), plain(x))).otherwise(plain(x))
    words = named.select("key", F.transform("marked", lambda x: F.when(F.ascii(x) == FIRST, own(x)).otherwise(x)).alias("words"))
    words = words.select("key", numbers_joined(F.col("words")).alias("words"))
    return words.select("key", "words", F.transform("words", symbol).alias("symbols"))


def windows(rows: DataFrame) -> DataFrame:
    """key, words, symbols, position, template (hash) of each window of tokenised rows."""
    n = F.size("symbols") - WINDOW
    template = lambda i: F.xxhash64(*[F.col("symbols")[i + k] for k in range(WINDOW)])
    hashed = rows.select("key", "words", "symbols", F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), template)).alias("templates"))
    # the outer form: for the inner one Spark would compute all of this once more to filter empty arrays
    return hashed.select("key", "words", "symbols", F.posexplode_outer("templates").alias("position", "template")).filter("template is not null")


def _is_slot(x: Column) -> Column:
    return x.between(NUMBER, UNIT)


def _piece(column: str, at: Column, length: int = WINDOW) -> Column:
    return F.slice(column, at + 1, F.lit(length))


def _literals(symbols: Column) -> Column:
    return F.size(F.array_distinct(F.filter(symbols, lambda x: ~_is_slot(x))))


def classed(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """cls, key (item id), words, symbols of every item; items of a class have the same symbols and equal values in the same places."""
    rows = tokenised(benchmark.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))).filter(F.size("words") > 0)
    slots = rows.withColumn("slots", F.transform(F.filter(F.arrays_zip(F.col("symbols").alias("s"), F.col("words").alias("w")), lambda x: _is_slot(x["s"])), lambda x: x["w"]))
    return slots.select(F.xxhash64("symbols", F.transform("slots", lambda x: F.array_position("slots", x))).alias("cls"), "key", "words", "symbols")


def _unmarked(words: str) -> Column:
    return F.transform(words, lambda x: F.when(F.ascii(x).isin(NAME, UNIT), F.substring(x, 2, 1 << 30)).otherwise(x))


def _verbatim_windows(items: DataFrame) -> DataFrame:
    """cls, item_position, length, value of windows with few literal words, and of items shorter than a window."""
    items = items.withColumn("words", _unmarked("words"))
    own = windows(items.select(F.col("cls").alias("key"), "words", "symbols"))
    poor = own.filter(_literals(_piece("symbols", F.col("position"))) < LITERALS)
    long = poor.select(F.col("key").alias("cls"), F.col("position").alias("item_position"), F.lit(WINDOW).alias("length"), F.xxhash64(_piece("words", F.col("position"))).alias("value"))
    short = items.filter(F.size("words") < WINDOW).select("cls", F.lit(0).alias("item_position"), F.size("words").alias("length"), F.xxhash64("words").alias("value"))
    return long.unionByName(short).distinct()


def _verbatim_hits(docs: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """Hits of word-for-word windows; ``wanted`` is written. None without such windows."""
    found, docs = None, docs.select("key", _unmarked("words").alias("words"))
    for length in sorted(r["length"] for r in wanted.select("length").distinct().collect()):  # 1 to WINDOW
        n = F.size("words") - length
        fits = n >= 0 if length >= LEAST_INSIDE else n == 0
        places = docs.select("key", F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice("words", i + 1, F.lit(length))))).alias("values"))  # noqa: B023
        places = places.select("key", F.posexplode_outer("values").alias("position", "value")).filter("value is not null")
        hits = places.join(sized(wanted.filter(F.col("length") == length).drop("length"), BROADCAST_WINDOWS), "value")
        found = hits if found is None else found.unionByName(hits)
    return found


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, kind (verbatim or reparameterised), windows, item_windows, items, consistent of every contaminated document.

    ``item_id``: the first item of the class; ``items``: how many items the class has; ``consistent``: an alignment maps its values one to one.
    """
    items = cut(classed(benchmark, item_col, item_text_col), "benchmark-items")
    classes = cut(items.groupBy("cls").agg(F.min(F.struct("key", "words", "symbols")).alias("x"), F.count(F.lit(1)).alias("items")).select("cls", "x.key", "x.words", "x.symbols", "items"), "benchmark-classes")
    own_windows = windows(classes.select(F.col("cls").alias("key"), "words", "symbols"))
    own_windows = own_windows.select("template", F.col("key").alias("cls"), F.col("position").alias("item_position"), _piece("words", F.col("position")).alias("item_values"), _piece("symbols", F.col("position")).alias("item_symbols"))
    targets = cut(own_windows.filter(_literals(F.col("item_symbols")) >= LITERALS), "benchmark-windows")
    few = targets.limit(broadcast_windows + 1).count() <= broadcast_windows

    read = tokenised(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")))
    own = windows(read)
    if few:
        found = own.join(F.broadcast(targets), "template").withColumn("values", _piece("words", F.col("position")))
    else:  # only windows that some item has keep their words
        found = own.select("key", "position", "template", _piece("words", F.col("position")).alias("values")).join(targets, "template")
    # the join and the cut of the window stay in one stage of generated code, so that no row carries the whole text; what
    # takes a lambda comes after it, and the filter after writing, lest it become a condition of the join
    found = found.select("key", "cls", "position", "item_position", "item_values", "item_symbols", "values")
    triples = F.arrays_zip(F.col("item_symbols").alias("s"), F.col("item_values").alias("a"), F.col("values").alias("b"))
    words_agree = F.forall(triples, lambda x: _is_slot(x["s"]) | (x["a"] == x["b"]))
    slots = F.transform(F.filter(triples, lambda x: _is_slot(x["s"])), lambda x: F.struct(x["s"].cast("int").alias("s"), x["a"].alias("a"), x["b"].alias("b")))
    hits = found.select(F.col("key").alias("doc_id"), "cls", "position", "item_position", F.xxhash64("values").alias("value"), slots.alias("slots"), words_agree.alias("words_agree"))
    hits = cut(hits, "template-hits").filter("words_agree")
    # values are an item's if some item of the class has them in this window
    of_items = windows(items.select(F.col("cls").alias("key"), "words", "symbols")).select(F.col("key").alias("cls"), F.col("position").alias("item_position"), F.xxhash64(_piece("words", F.col("position"))).alias("value"), F.lit(True).alias("same")).distinct()
    of_items = sized(cut(of_items, "item-values"), broadcast_windows)
    aligned = hits.join(of_items, ["cls", "item_position", "value"], "left").select("doc_id", "cls", "position", "item_position", "slots", F.col("same").isNull().alias("other"), F.lit(True).alias("template"))
    exact = _verbatim_hits(read, cut(_verbatim_windows(items), "verbatim-windows"))
    if exact is not None:
        exact = cut(exact, "verbatim-hits")
        aligned = aligned.unionByName(exact.select(F.col("key").alias("doc_id"), "cls", "position", "item_position", F.expr("cast(array() as array<struct<s:int,a:string,b:string>>)").alias("slots"), F.lit(False).alias("other"), F.lit(False).alias("template")))

    by = ["doc_id", "cls", "offset"]
    aligned = aligned.withColumn("offset", F.col("position") - F.col("item_position"))
    # values of an item that have two values in the document
    pairs = aligned.select(*by, F.explode("slots").alias("x")).groupBy(*by, "x.s", "x.a").agg(F.count_distinct("x.b").alias("n")).filter("n > 1")
    torn = pairs.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.collect_set(F.struct("s", "a")).alias("torn"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    joined = aligned.join(torn, same[0] & same[1] & same[2], "left").select(*by, "item_position", "other", "slots", "torn", "template")
    shows = lambda kind: F.exists("slots", lambda x: kind(x) & F.array_contains("torn", F.struct(x["s"], x["a"])))
    clear = ~F.col("other") | F.col("torn").isNull()
    place = lambda kind: F.when(clear | ~shows(kind), F.col("item_position"))
    loose, strict = place(lambda x: x["s"] == NAME), place(lambda x: F.lit(True))
    of_templates = lambda p: F.count_distinct(F.when(F.col("template"), p))
    checked = joined.groupBy(*by).agg(F.count_distinct(loose).alias("loose"), of_templates(loose).alias("loose_templates"), F.count_distinct(strict).alias("strict"), of_templates(strict).alias("strict_templates"), F.max(F.col("other").cast("int")).alias("other"), F.min(F.col("torn").isNull()).alias("consistent"))

    n_templates = targets.groupBy("cls").agg(F.count(F.lit(1)).alias("item_templates"))
    sizes = classes.join(n_templates, "cls", "left").select("cls", F.col("key").alias("item_id"), "items", F.greatest(F.size("words") - WINDOW + 1, F.lit(1)).alias("item_windows"), F.coalesce("item_templates", F.lit(0)).alias("item_templates"))
    sizes = F.broadcast(sizes) if few else sizes
    sized_up = checked.join(sizes, "cls")
    # an item that is there with all its windows, or all its windows of templates, needs no one-to-one numbers
    whole = (F.col("loose") >= F.col("item_windows")) | ((F.col("item_templates") > 0) & (F.col("loose_templates") >= F.col("item_templates")))
    counted = lambda kind: F.when(whole, F.col(f"loose{kind}")).otherwise(F.col(f"strict{kind}"))
    half = lambda n: F.least(F.lit(NEED), F.ceil(F.col(n) / 2))
    enough = (counted("") >= half("item_windows")) | ((F.col("item_templates") > 0) & (counted("_templates") >= half("item_templates")))
    best = sized_up.filter(enough).groupBy("doc_id", "cls", "item_id", "items", "item_windows").agg(F.max(counted("")).alias("windows"), F.min("other").alias("other"), F.max("consistent").alias("consistent"))
    return best.select("doc_id", "item_id", F.when(F.col("other") == 0, "verbatim").otherwise("reparameterised").alias("kind"), F.col("windows").cast("long").alias("windows"), F.col("item_windows").cast("long").alias("item_windows"), "items", "consistent")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, columns unchanged. Rows are judged one by one, also where ids are null or repeated."""
    keyed = with_row_ids(docs, id_col, text_col)
    found = settled(lambda: contaminations(keyed, benchmark, ROW, text_col).select(F.col("doc_id").alias(ROW)).distinct(), "contaminated")
    return without_row_ids(keyed, found)
