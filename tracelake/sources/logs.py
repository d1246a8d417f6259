"""Text logs of bus frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fields import DIGITS, HEX, made_of, words
from ..functions.once import with_computed
from ..functions.times import parse_date_line
from ..operators.decode import small, spread
from ..operators.frames import id_text, payload_text
from ..operators.ranges import Ranged
from ..storage import written


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """``source_id, line, value`` of text files, lines numbered from 1 as one sequential read would.

    Files are read in splits. Spark's running row ids are consecutive inside a split, so a line's number is
    its id less the split's first id, plus the lines of the splits before: a first read counts the lines of
    each split (one row a split, written out), a second one numbers them. No text is shuffled. Should the files
    be split otherwise the second time, the job fails and does not number wrongly.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    counts = written(raw.groupBy("source_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_id")))
    w = Window.partitionBy("source_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("lines").over(w), F.lit(0)))
    within = F.col("id") - F.col("first_id")
    failed = F.raise_error(F.lit("the files were split otherwise when they were read again")).cast("long")
    line = F.when((within >= 0) & (within < F.col("lines")), F.col("before") + within + 1).otherwise(failed)
    return raw.join(small(starts), ["source_id", "block"], "left").select("source_id", line.alias("line"), "value")


def parse_can_id(text: Column, base: Column) -> tuple[Column, Column]:
    """(id, extended) of an id text in base ``hex`` or ``dec``; a trailing ``x`` or an id above 7FF is extended."""
    t = F.lower(F.trim(text))
    marked = t.endswith("x")
    figures = F.when(marked, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    hexadecimal = F.when(figures.startswith("0x"), F.substring(figures, F.lit(3), F.length(figures))).otherwise(figures)
    number = F.when((base == "hex") & made_of(hexadecimal, HEX) & (F.length(hexadecimal) <= 15), F.conv(hexadecimal, 16, 10).cast("long"))
    number = number.when((base == "dec") & made_of(figures, DIGITS) & (F.length(figures) <= 18), figures.try_cast("long"))
    number = F.when(number <= 0x1FFFFFFF, number).cast("int")
    return number, marked | (number > 0x7FF)


def _seconds(word: Column) -> Column:
    """A decimal number of seconds, null for anything else."""
    unsigned = F.when(word.startswith("-") | word.startswith("+"), F.substring(word, F.lit(2), F.length(word))).otherwise(word)
    plain = made_of(unsigned, DIGITS + ".") & ~unsigned.startswith(".") & ~unsigned.endswith(".")
    return F.when(plain, word.try_cast("decimal(30,9)"))


def _payload(tokens: Column, length: Column) -> Column:
    part = F.slice(tokens, F.lit(1), length)
    good = (F.size(tokens) >= length) & F.forall(part, lambda b: made_of(b, HEX) & (F.length(b) <= 2))
    return F.when(good, F.unhex(F.array_join(F.transform(part, lambda b: F.lpad(b, 2, "0")), "")))


#: Lines in a block; a line is compared with the ``base`` lines of its own block only.
BASE_BLOCK = 256


def _with_base(rows: DataFrame, lines: DataFrame, toggles: DataFrame) -> DataFrame:
    """``rows`` with the ``base`` that the last of ``toggles(source_id, from_line, base)`` before their line switched to, ``hex`` before the first.

    A log may switch very often. Each block of lines has the switches inside it and the one it begins with, carried over blocks,
    so a line meets one row in an equi-join on its block.
    """
    block = lambda line: F.floor(F.col(line) / BASE_BLOCK).alias("__block")
    inside = toggles.groupBy("source_id", block("from_line")).agg(F.array_sort(F.collect_list(F.struct("from_line", "base"))).alias("__inside"))
    blocks = written(lines.select("source_id", block("line")).distinct().join(inside, ["source_id", "__block"], "left"))
    last = F.when(F.col("__inside").isNotNull(), F.struct("__block", F.element_at("__inside", -1)["base"].alias("base")))
    blocks = Ranged(blocks, ["source_id"], ("__block",)).running(__upto=(F.max, last)).lag(__before="__upto").done()
    known = written(blocks.filter("__upto is not null").select("source_id", "__block", "__inside", F.col("__before.base").alias("__begins")))
    rows = rows.withColumn("__block", block("line")).join(small(known), ["source_id", "__block"], "left")
    here = F.try_element_at(F.filter("__inside", lambda t: t["from_line"] < F.col("line")), F.lit(-1))["base"]
    return rows.withColumn("base", F.coalesce(here, F.col("__begins"), F.lit("hex"))).drop("__block", "__inside", "__begins")


def parse_asc(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, diagnostics, time references) of numbered text lines ``source_id, line, value``.

    A line is cut into words and its fields are read by their place: ``time channel id direction d|r length
    bytes`` for classic rows, ``time CANFD channel direction id [name] brs esi dlc length bytes`` for FD rows.
    ``base`` lines switch how ids and FD lengths are written for all lines after them. Rows that cannot be
    read in full become diagnostics; none is dropped silently or filled up.
    """
    dealt = spread(lines, "line")
    l = with_computed(dealt, {"word": words(F.col("value"))})
    at = lambda i: F.get("word", F.lit(i))
    first, n = F.lower(at(0)), F.size("word")
    fd_row = (F.lower(at(1)) == "canfd") & _seconds(at(0)).isNotNull() & (n > 2)
    id_figures = F.when(at(2).endswith("x"), F.substring(at(2), F.lit(1), F.length(at(2)) - 1)).otherwise(at(2))
    classic_row = (n >= 6) & _seconds(at(0)).isNotNull() & made_of(at(1), DIGITS) & made_of(id_figures, HEX) & at(3).isin("Rx", "Tx") & at(4).isin("d", "r") & made_of(at(5), DIGITS)
    comment = first.startswith("//") | first.startswith("timestamps") | ((first == "internal") & F.lower(at(1)).startswith("events"))
    kind = (
        F.when(n == 0, "ignored").when((first == "base") & (n > 1), "base").when((first == "date") & (n > 1), "date")
        .when(comment, "ignored").when(fd_row, "fd").when(classic_row, "classic").otherwise("other")
    )
    l = with_computed(l, {"kind": kind}).filter("kind <> 'ignored'")
    # Read from the lines that begin so, not from all lines cut into words.
    heads = lines.filter(F.lower(F.ltrim(F.translate("value", "\t\r\n\f\x0b", "     "))).startswith("base")).withColumn("word", words(F.col("value"))).filter((first == "base") & (n > 1))
    toggles = heads.select("source_id", F.col("line").alias("from_line"), F.when(F.array_contains(F.transform("word", F.lower), "dec"), "dec").otherwise("hex").alias("base"))
    l = _with_base(l, lines, written(toggles)).filter("kind <> 'base'")
    is_fd = F.col("kind") == "fd"
    named = F.coalesce(~made_of(at(5), DIGITS) & at(5).isNotNull(), F.lit(False)).cast("int")
    l = with_computed(l, {"skip": F.when(is_fd, named).otherwise(0)})
    fd = lambda i: F.get("word", F.col("skip") + i)
    dlc = F.when(F.col("base") == "hex", F.when(made_of(fd(7), HEX), F.conv(fd(7), 16, 10))).otherwise(fd(7)).try_cast("int")
    bytes_from = F.when(is_fd, F.col("skip") + 10).otherwise(7)
    l = with_computed(l, {
        "time": _seconds(at(0)),
        "channel": F.when(is_fd, at(2)).otherwise(at(1)).try_cast("int"),
        "id": F.when(is_fd, at(4)).otherwise(at(2)),
        "direction": at(3),
        "dlc": F.when(is_fd, dlc).otherwise(at(5).try_cast("int")),
        "length": F.when(is_fd, fd(8).try_cast("int")).when(at(4) == "r", 0).otherwise(at(5).try_cast("int")),
        "tokens": F.slice("word", bytes_from, F.greatest(n - bytes_from + 1, F.lit(0))),
        "flags": ~is_fd | (made_of(fd(5), DIGITS) & made_of(fd(6), DIGITS)),
    })
    can_id, extended = parse_can_id(F.col("id"), F.col("base"))
    payload = F.when(F.col("length").between(0, 64), _payload(F.col("tokens"), F.col("length")))
    l = with_computed(l, {"can_id": can_id, "extended": extended, "data": payload})
    header = F.col("channel").isNotNull() & F.col("direction").isin("Rx", "Tx") & F.col("can_id").isNotNull()
    good_dlc = F.coalesce(F.col("dlc").between(0, F.when(is_fd, 15).otherwise(8)) & F.col("length").between(0, 64), F.lit(False))
    code = (
        F.when(F.col("kind") == "other", "ASC_UNSUPPORTED_ROW")
        .when(~F.coalesce(header, F.lit(False)) | (~is_fd & ~good_dlc), F.when(is_fd, "ASC_FD_HEADER").otherwise("ASC_CLASSIC_HEADER"))
        .when(~F.col("flags"), "ASC_FD_FLAGS").when(~good_dlc, "ASC_FD_LENGTH")
        .when(F.col("data").isNull(), F.when(is_fd, "ASC_FD_PAYLOAD").otherwise("ASC_CLASSIC_PAYLOAD"))
    )
    l = with_computed(l, {"code": code})
    rows = l.filter("kind <> 'date'")
    frames = rows.filter("code is null").select(
        "source_id", F.col("line").alias("ordinal"), F.round(F.col("time") * 1000000, 0).cast("long").alias("t_us"), F.col("time").cast("double").alias("ts"), "can_id", "extended", "direction", "channel",
        F.col("dlc").alias("dlc_code"), F.col("length").alias("data_length"), "data",
    )
    bad = rows.filter("code is not null").select("source_id", F.lit("parser").alias("origin"), "code", F.lit("warning").alias("severity"), F.col("value").alias("message"), F.col("line").cast("double").alias("position"))
    first_frames = rows.filter("code is null").groupBy("source_id").agg(F.min("line").alias("first_line"))
    dates = l.filter("kind = 'date'").select("source_id", "line", parse_date_line(F.col("value")).alias("start_us")).filter("start_us is not null")
    refs = dates.join(first_frames, "source_id", "left").filter("first_line is null or line < first_line").groupBy("source_id").agg(F.min_by("start_us", "line").alias("start_us"))
    return frames, bad, refs


def asc_lines(frames: DataFrame) -> DataFrame:
    """Classic log lines of frames: ``source_id, line, value``."""
    text = F.format_string("%s %d %s %s d %d %s", F.format_string("%.6f", "ts"), "channel", id_text(F.col("can_id"), F.col("extended")), "direction", "dlc_code", payload_text(F.col("data")))
    return frames.select("source_id", F.col("ordinal").alias("line"), text.alias("value"))


def read_asc(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_asc(numbered_lines(spark, paths))
