"""Signal databases in their text form: read into layouts and value labels, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale
from ..functions.fields import DIGITS, HEX, after, before, digits, first_word, made_of, words
from ..functions.once import let, with_computed
from ..functions.text import significant
from ..operators.decode import small
from ..storage import written

NUMBER = DIGITS + "+-.eE"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"
#: Stand for an escaped backslash and an escaped quote while a line is cut at its quotes.
BACKSLASH, QUOTE = chr(1), chr(2)


def _masked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))


def _unmasked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(QUOTE), F.lit('"')), F.lit(BACKSLASH), F.lit("\\"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def identifier(text: Column) -> Column:
    return made_of(text, LETTERS + DIGITS) & ~made_of(F.substring(text, 1, 1), DIGITS)


def message_id(text: Column) -> tuple[Column, Column]:
    """(id, extended) of a message number, decimal or ``0x``; bit 31 marks extended ids, as does a size above 7FF."""
    t = F.lower(text)
    figures = F.substring(t, F.lit(3), F.length(t))
    raw = F.when(t.startswith("0x"), F.when(made_of(figures, HEX) & (F.length(figures) <= 15), F.conv(figures, 16, 10))).when(digits(t), t).try_cast("long")
    number = lambda n: F.when(n >= 0x80000000, n - 0x80000000).otherwise(n)
    known = lambda n: (n <= 0xFFFFFFFF) & (number(n) <= 0x1FFFFFFF)
    return let(raw, lambda n: F.when(known(n), number(n)).cast("int")), let(raw, lambda n: F.when(known(n), (n >= 0x80000000) | (number(n) > 0x7FF)))


def slug(name: Column) -> Column:
    """A name as part of an id: lower case, runs of other characters as one dash."""
    s = F.trim(F.regexp_replace(F.lower(name), r"[^a-z0-9._-]+", " "))
    return F.when(s == "", "signal").otherwise(F.translate(s, " ", "-"))


def statements(lines: DataFrame) -> DataFrame:
    """``source_id, line, value, keyword, statement``: lines carried to the statement they belong to, by a running count.

    A statement begins with a keyword, a word of capitals that ends in ``_`` (``BO_``, ``SG_``, ``VAL_`` ...) or
    in a colon; any other line, as of value labels over several lines, continues the one before.
    """
    # Cut off, and once a row: all words of a line cost many times as much.
    rows = with_computed(lines, {"__first": first_word(F.col("value"))})
    first = F.col("__first")
    keyword = F.when(made_of(first, "ABCDEFGHIJKLMNOPQRSTUVWXYZ_") & first.endswith("_"), first).when(first.endswith(":") | (first == "VERSION"), first)
    rows = with_computed(rows, {"keyword": keyword}).drop("__first")
    w = Window.partitionBy("source_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("statement", F.count("keyword").over(w))


def _whole(rows: DataFrame, keyword: str) -> DataFrame:
    """``source_id, line, value`` of the statements with a keyword, their lines joined."""
    found = rows.groupBy("source_id", "statement").agg(F.max("keyword").alias("keyword"), F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    return found.filter(F.col("keyword") == keyword).select("source_id", "line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))


def parse_dbc(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layouts, value labels, diagnostics) of database lines ``source_id, line, value``.

    The layouts go straight into ``decode`` and the labels into ``with_labels``: both carry ``signal_id``; the file is
    named in ``database``. Lines are cut into words and punctuation; a signal belongs to the message line before it,
    carried down each file in line order. Start bits of big-endian signals name the most significant bit.
    What cannot be read is reported with its line: signals without message or with wrong syntax or conversion, value
    types and labels that name no signal or do not fit it, and multiplexing ranges.
    """
    rows = statements(lines)
    word = F.when(F.col("keyword") == "BO_", words(F.translate("value", ":", " ")))
    get = lambda i: F.get("word", F.lit(i))

    # Messages, carried to the signals below them.
    can_id, extended = message_id(get(1))
    rows = with_computed(rows, {"word": word})
    is_message = (F.col("keyword") == "BO_") & identifier(get(2)) & digits(get(3)) & get(4).isNotNull() & (F.instr("value", ":") > 0)
    message = F.when(is_message, F.struct(can_id.alias("can_id"), extended.alias("extended"), get(2).alias("message"), get(3).try_cast("int").alias("frame_bytes")))
    w = Window.partitionBy("source_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    # Read many times below; a database is small.
    rows = written(rows.withColumn("m", F.last(message, True).over(w)))

    # Signals: what stands before the colon, the numbers, and the quoted unit.
    s = rows.filter("keyword = 'SG_'").withColumn("__text", _masked(F.col("value")))
    numbers = before(after(F.col("__text"), ":"), '"')
    s = with_computed(s, {"head": words(before(F.col("value"), ":")), "number": words(F.translate(numbers, "|@(),[]", "       ")), "marks": F.translate(numbers, NUMBER + " \t", ""), "unit": _unmasked(F.get(F.split("__text", '"'), F.lit(1))), "quoted": F.size(F.split("__text", '"')) > 2})
    num = lambda i: F.get("number", F.lit(i))
    marker = F.coalesce(F.get("head", F.lit(2)), F.lit(""))
    branch = F.when(marker.startswith("m"), F.regexp_substr(marker, F.lit(r"\d+")).try_cast("long"))
    known_marker = (marker == "") | (marker == "M") | branch.isNotNull()
    order, sign = F.substring(num(2), 1, 1), F.substring(num(2), 2, 1)
    syntax = (
        identifier(F.get("head", F.lit(1))) & (F.size("head") <= 3) & known_marker & (F.col("marks") == "|@(,)[|]") & (F.size("number") == 7) & F.col("quoted")
        & digits(num(0), 1, 9) & digits(num(1), 1, 9) & order.isin("0", "1") & sign.isin("+", "-") & (F.length(num(2)) == 2)
        & F.forall(F.slice("number", 4, 4), lambda x: x.try_cast("double").isNotNull())
    )
    finite = F.forall(F.slice("number", 4, 4), lambda x: F.abs(x.try_cast("double")) < float("inf")) & (num(3).try_cast("double") != 0)
    start, little = num(0).try_cast("int"), order == "1"
    problem = (
        F.when(F.col("m").isNull() | F.col("m.can_id").isNull(), "DBC_SIGNAL_WITHOUT_MESSAGE").when(~F.coalesce(syntax, F.lit(False)), "DBC_SIGNAL_SYNTAX").when(~F.coalesce(finite, F.lit(False)), "DBC_SIGNAL_CONVERSION")
    )
    s = written(with_computed(s, {"problem": problem}))
    def_id = F.concat(F.lit("dbc-"), F.when(F.col("m.extended"), "e").otherwise("s"), F.lit("-"), F.lower(F.hex("m.can_id")))
    signals = s.filter("problem is null").select(
        F.col("source_id").alias("database"), "line", def_id.alias("def_id"), "m.can_id", "m.extended", "m.message", "m.frame_bytes", F.get("head", F.lit(1)).alias("name"), "unit",
        F.floor(start / 8).cast("int").alias("byte_offset"), F.when(little, start % 8).otherwise(7 - start % 8).alias("bit_offset"), num(1).try_cast("int").alias("length_bits"),
        F.when(sign == "-", "signed").otherwise("unsigned").alias("sign"), F.when(little, "little").otherwise("big").alias("byte_order"), num(3).alias("scale"), num(4).alias("offset"),
        num(5).try_cast("double").alias("minimum"), num(6).try_cast("double").alias("maximum"),
        F.when(marker == "M", "selector").when(marker != "", "conditional").otherwise("none").alias("marker"),
        F.when(branch.isNotNull(), F.array(F.struct(branch.alias("lo"), branch.alias("hi")))).alias("own_ranges"),
    )
    place = F.row_number().over(Window.partitionBy("database", "def_id", slug(F.col("name"))).orderBy("line"))
    signals = written(signals.withColumn("signal_id", F.concat_ws("-", "def_id", slug(F.col("name")), F.when(place > 1, place))))
    # The first signal of a name is what other records refer to.
    key = ["database", "can_id", "extended", "name"]
    named = written(signals.groupBy(*key).agg(F.min_by("signal_id", "line").alias("signal_id"), F.min_by("length_bits", "line").alias("length_bits")))

    def reference(keyword: str, cleaned: str, name_at: int = 2) -> DataFrame:
        """Records of a keyword with the id and signal name they refer to."""
        r = rows.filter(F.col("keyword") == keyword).withColumn("word", words(F.translate("value", cleaned, " " * len(cleaned))))
        rid, rext = message_id(get(1))
        return r.select(F.col("source_id").alias("database"), "line", "value", "word", rid.alias("can_id"), rext.alias("extended"), get(name_at).alias("name"))

    # Value types: 1 for 32 bits, 2 for 64.
    types = reference("SIG_VALTYPE_", ":;").withColumn("type", get(3).try_cast("int")).join(small(named), key, "left")
    fits = ((F.col("type") == 1) & (F.col("length_bits") == 32)) | ((F.col("type") == 2) & (F.col("length_bits") == 64))
    type_problem = F.when(F.col("signal_id").isNull(), "DBC_VALUE_TYPE_REFERENCE").when((F.col("type") != 0) & ~F.coalesce(fits, F.lit(False)), "DBC_VALUE_TYPE_INVALID")
    types = written(types.withColumn("problem", type_problem))
    floats = types.filter("problem is null and type > 0").select("database", "signal_id", F.lit(True).alias("is_float")).distinct()

    # Ranges of multiplexed signals, up to the semicolon.
    ranges = reference("SG_MUL_VAL_", "").withColumn("selector", get(3))
    text = F.array_join(F.slice("word", 5, F.greatest(F.size("word") - 4, F.lit(0))), " ")
    pair = F.transform(F.split(before(text, ";"), ","), lambda p: F.struct(F.trim(F.substring_index(p, "-", 1)).try_cast("long").alias("lo"), F.trim(F.substring_index(p, "-", -1)).try_cast("long").alias("hi")))
    readable = F.contains("value", F.lit(";")) & F.forall(pair, lambda p: F.coalesce((p["lo"] >= 0) & (p["hi"] >= p["lo"]), F.lit(False)))
    selectors = named.select("database", "can_id", "extended", F.col("name").alias("selector"), F.col("signal_id").alias("selector_id"))
    ranges = ranges.withColumn("more", F.when(readable, pair)).join(small(named), key, "left").join(small(selectors), ["database", "can_id", "extended", "selector"], "left")
    frames = named.select("database", "can_id", "extended").distinct().withColumn("known", F.lit(True))
    ranges = ranges.join(small(frames), ["database", "can_id", "extended"], "left")
    range_problem = F.when(F.col("known").isNull(), "DBC_MULTIPLEXING_FRAME").when(F.col("signal_id").isNull() | F.col("selector_id").isNull() | F.col("more").isNull(), "DBC_MULTIPLEXING_REFERENCE")
    ranges = written(ranges.withColumn("problem", range_problem))
    good_ranges = ranges.filter("problem is null").groupBy("database", "signal_id").agg(F.max_by("more", "line").alias("more"))
    chosen = ranges.filter("problem is null").select("database", F.col("selector_id").alias("signal_id"), F.lit(True).alias("chosen")).distinct()

    out = signals.join(small(floats), ["database", "signal_id"], "left").join(small(good_ranges), ["database", "signal_id"], "left").join(small(chosen), ["database", "signal_id"], "left")
    out = out.select(
        "database", "def_id", "can_id", "extended", "signal_id", "name", "unit", "byte_offset", "bit_offset", "length_bits", F.when(F.col("is_float"), "float").otherwise(F.col("sign")).alias("signedness"), "byte_order", "scale", "offset",
        F.when(F.col("chosen"), "selector").when(F.col("more").isNotNull(), "conditional").otherwise(F.col("marker")).alias("mux_role"), F.coalesce("more", "own_ranges").alias("mux_ranges"),
        "message", "frame_bytes", "minimum", "maximum",
    )

    # Value labels: between quotes stand the labels, before each its number, behind the last the semicolon.
    v = _whole(rows, "VAL_").withColumn("__text", _masked(F.col("value"))).withColumn("word", words(before(F.col("__text"), '"')))
    v = v.filter(made_of(F.substring(get(1), 1, 1), DIGITS))
    vid, vext = message_id(get(1))
    part = F.split("__text", '"')
    count = F.floor((F.size(part) - 1) / 2).cast("int")
    entries = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.element_at(words(F.get(part, 2 * i)), -1).alias("raw"), _unmasked(F.get(part, 2 * i + 1)).alias("label"), F.size(words(F.get(part, 2 * i))).alias("n_words")))
    v = with_computed(v.select(F.col("source_id").alias("database"), "line", vid.alias("can_id"), vext.alias("extended"), get(2).alias("name"), "__text", "word"), {"entries": entries, "n_parts": F.size(part), "tail": F.trim(F.element_at(part, -1))})
    number = lambda e: e["raw"].try_cast("decimal(38,0)")
    whole = lambda e: made_of(F.translate(F.substring(e["raw"], 1, 1), "+-", "0"), DIGITS) & made_of(F.concat(F.lit("0"), F.substring(e["raw"], F.lit(2), F.length(e["raw"]))), DIGITS)
    well = (F.size("entries") > 0) & (F.col("n_parts") % 2 == 1) & F.col("tail").startswith(";") & F.forall("entries", whole) & F.forall(F.slice("entries", 2, F.greatest(F.size("entries") - 1, F.lit(0))), lambda e: e["n_words"] == 1) & (F.get("entries", F.lit(0))["n_words"] == 4)
    alone = F.size(F.array_distinct(F.transform("entries", number))) == F.size("entries")
    v = v.join(small(named), key, "left")
    label_problem = F.when(~F.col("tail").startswith(";"), "DBC_VALUE_LABEL_SYNTAX").when(F.col("signal_id").isNull(), "DBC_VALUE_LABEL_REFERENCE").when(~F.coalesce(well & alone, F.lit(False)), "DBC_VALUE_LABEL_SYNTAX")
    v = v.withColumn("problem", label_problem)
    labels = v.filter("problem is null").select("database", "can_id", "extended", "name", "signal_id", F.explode("entries").alias("e")).select("database", "can_id", "extended", "name", "signal_id", number(F.col("e")).cast("string").alias("raw_text"), F.col("e.label").alias("label"))

    def report(found: DataFrame, code: Column | str, name: str = "name", severity: str = "warning") -> DataFrame:
        return found.select(F.col("database").alias("source_id") if "database" in found.columns else F.col("source_id"), "line", (F.col(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.coalesce(F.col(name), F.lit("")).alias("message"))

    numbered = rows.filter(is_message).select("source_id", "line", get(2).alias("name"), message_id(get(1))[0].alias("can_id"), get(1).try_cast("long").alias("raw"))
    inferred = numbered.filter("can_id is not null and raw > 2047 and raw < 2147483648")
    bad = (
        report(s.filter("problem is not null").withColumn("name", F.get("head", F.lit(1))), "problem", severity="error")
        .union(report(numbered.filter("can_id is null"), F.lit("DBC_MESSAGE_ID"), severity="error"))
        .union(report(inferred, F.lit("DBC_EXTENDED_ID_INFERRED")))
        .union(report(types.filter("problem is not null"), "problem")).union(report(ranges.filter("problem is not null"), "problem")).union(report(v.filter("problem is not null"), "problem"))
    )
    return out, labels, bad


def export_name(name: Column, fallback: Column | str) -> Column:
    """A name as an identifier: other characters become ``_``, and it begins with a letter or ``_``."""
    base = F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_]", "_"), r"^[^A-Za-z_]+", "")
    return F.when(base == "", fallback).otherwise(base)


def _unique(base: Column, *scope: str) -> Column:
    """The name, or the name with its place behind it where an earlier row of the scope has it already."""
    n = F.row_number().over(Window.partitionBy(*scope, base).orderBy("can_id", "extended", "__order"))
    return F.when(n == 1, base).otherwise(F.concat_ws("_", base, n))


def exported_names(layouts: DataFrame) -> DataFrame:
    """``layouts`` with ``message_name, signal_name``: identifiers, unique among messages and in each message."""
    heads = layouts.select("can_id", "extended", "message").distinct().withColumn("__order", F.lit(0))
    heads = heads.withColumn("message_name", _unique(export_name(F.col("message"), F.concat(F.lit("Frame_"), F.hex("can_id"))))).drop("__order", "message")
    ordered = layouts.withColumn("__order", F.struct("byte_offset", "bit_offset", "signal_id"))
    return ordered.withColumn("signal_name", _unique(export_name(F.col("name"), "Signal"), "can_id", "extended")).join(small(heads), ["can_id", "extended"]).drop("__order")


def dbc_lines(layouts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Database lines of layouts ``message, frame_bytes, minimum, maximum`` and the layout columns: ``can_id, extended, place, value``.

    Messages first (place 0), each with its signals (1), value labels (2, ``labels(signal_id, raw_text, label)``) and ranges
    of multiplexed signals (3), float types last (4). Names become identifiers; a range that is not given is
    that of the raw integers, scaled; floats without one have ``[0|0]``.
    """
    rows = exported_names(layouts)
    number = F.when(F.col("extended"), F.col("can_id").cast("long") + 0x80000000).otherwise(F.col("can_id").cast("long"))
    head = rows.select("can_id", "extended", "message_name", "frame_bytes").distinct().select("can_id", "extended", F.lit(0).alias("place"), F.format_string("BO_ %d %s: %d Vector__XXX", number, "message_name", "frame_bytes").alias("value"))
    start = F.col("byte_offset") * 8 + F.when(F.col("byte_order") == "little", F.col("bit_offset")).otherwise(7 - F.col("bit_offset"))
    marker = F.when(F.col("mux_role") == "selector", " M").when(F.col("mux_role") == "conditional", F.concat(F.lit(" m"), F.get("mux_ranges", F.lit(0))["lo"].cast("string"))).otherwise("")
    # Scale, ends and their texts each stand in columns of their own: nested, the text of a scale would be read some hundred times a row.
    parts = scale.scale_parts(F.col("scale"))
    lines = with_computed(rows, {"__num": parts[0].cast("double"), "__den": parts[1].cast("double")})
    lines = with_computed(lines, {"__factor": F.col("__num") / F.col("__den"), "__shift": F.coalesce(F.col("offset").try_cast("double"), F.lit(0.0))})
    factor, shift = F.col("__factor"), F.col("__shift")
    signed, is_float = F.col("signedness") == "signed", F.col("signedness") == "float"
    top = F.pow(F.lit(2.0), F.col("length_bits") - signed.cast("int")) - 1
    ends = [F.when(signed, -top - 1).otherwise(0.0) * factor + shift, top * factor + shift]
    low = F.coalesce("minimum", F.when(is_float, 0.0).otherwise(F.least(*ends)))
    high = F.coalesce("maximum", F.when(is_float, 0.0).otherwise(F.greatest(*ends)))
    lines = with_computed(lines, {"__shown": F.transform(F.array(factor, shift, low, high), lambda x: significant(x, 12))})
    shown = [F.get("__shown", F.lit(i)) for i in range(4)]
    value = F.format_string(' SG_ %s%s : %d|%d@%s%s (%s,%s) [%s|%s] "%s" Vector__XXX', "signal_name", marker, start, "length_bits", F.when(F.col("byte_order") == "little", "1").otherwise("0"), F.when(F.col("signedness") == "unsigned", "+").otherwise("-"), *shown, escaped(F.col("unit")))
    out = head.union(lines.select("can_id", "extended", F.lit(1).alias("place"), value.alias("value")))
    if labels is not None:
        entry = F.struct(F.col("raw_text").try_cast("decimal(38,0)").alias("raw"), F.format_string('%s "%s"', "raw_text", escaped(F.col("label"))).alias("text"))
        joined = labels.groupBy("signal_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        named = rows.join(small(joined), "signal_id")
        texts = F.array_join(F.transform("entries", lambda e: e["text"]), " ")
        out = out.union(named.select("can_id", "extended", F.lit(2).alias("place"), F.format_string("VAL_ %d %s %s;", number, "signal_name", texts).alias("value")))
    selector = rows.filter("mux_role = 'selector'").select("can_id", "extended", F.col("signal_name").alias("selector"))
    spans = F.array_join(F.transform("mux_ranges", lambda r: F.concat(r["lo"].cast("string"), F.lit("-"), r["hi"].cast("string"))), ", ")
    several = rows.filter("mux_role = 'conditional' and (size(mux_ranges) > 1 or mux_ranges[0].lo <> mux_ranges[0].hi)").join(small(selector), ["can_id", "extended"])
    out = out.union(several.select("can_id", "extended", F.lit(3).alias("place"), F.format_string("SG_MUL_VAL_ %d %s %s %s;", number, "signal_name", "selector", spans).alias("value")))
    floats = rows.filter("signedness = 'float'")
    return out.union(floats.select("can_id", "extended", F.lit(4).alias("place"), F.format_string("SIG_VALTYPE_ %d %s : %d;", number, "signal_name", F.when(F.col("length_bits") == 64, 2).otherwise(1)).alias("value")))


def export_report(layouts: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``code, severity, message`` of an export: signal names that were changed, and derived signals, which databases cannot hold.

    ``derived`` has a row ``def_id, message`` for each derived signal.
    """
    changed = exported_names(layouts).filter("signal_name <> name").select(F.lit("DBC_NAME_NORMALIZED").alias("code"), F.lit("warning").alias("severity"), F.format_string("%s -> %s", "name", "signal_name").alias("message"))
    if derived is None:
        return changed
    skipped = derived.groupBy("def_id", "message").agg(F.count(F.lit(1)).alias("n"))
    return changed.union(skipped.select(F.lit("DBC_DERIVED_SIGNALS_SKIPPED"), F.lit("warning"), F.format_string("%s: %d", "message", "n")))
