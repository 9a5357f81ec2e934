"""Checklists against controls and uploaded files.

What is matched by containment is compared within one session, each normal form once with each upload; controls are matched
by an equi-join of words. Null and empty references match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import labels as L
from ..functions import text as X
from ..functions.rules import has_any
from ..functions.severity import cases


#: Up to so many controls, or normal forms of references, are broadcast; beyond that a session's uploads are dealt to so many tasks.
BROADCAST, SALTS = 100_000, 32
#: How well an upload of an equal name fits, and more than the uploads of a session.
EQUAL, PLACES = 1 << 29, 1 << 32


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def resolved(references: DataFrame, uploads: DataFrame, session: str, position: str, cell: str, name: str, order: str) -> DataFrame:
    """(session, position, nth, reference, file): each reference of a cell with the upload it means: of an equal name, else
    the longest name that contains the other, the first upload of equals. What matches no upload stays if it looks like a
    file, with a null file; prose goes.

    Each normal form of a session's references is compared once with each of its uploads, and only the best is kept: one
    number holds how well an upload fits and its place."""
    spark = references.sparkSession
    refs = references.select(session, position, F.posexplode(L.citations(F.col(cell))).alias("nth", "reference")).withColumn("_r", L.spelled(F.col("reference")))
    place = F.row_number().over(W.partitionBy(session).orderBy(order, name)).cast("long")
    files = uploads.filter(F.col(session).isNotNull()).select(session, place.alias("_i"), F.col(name).alias("_name"), L.spelled(F.col(name)).alias("_full"), L.spelled(_stem(F.col(name))).alias("_stem"))
    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_i")
    forms = refs.filter(F.col(session).isNotNull() & (F.col("_r") != "")).select(session, "_r").distinct()
    r, full, stem = F.col("_r"), F.col("_full"), F.col("_stem")
    length = lambda c: F.when((c == "") | (r == ""), 0).when(r.contains(c), F.length(c)).when(c.contains(r), F.length(r)).otherwise(0)
    n = F.when((r == stem) | (r == full), EQUAL).otherwise(F.greatest(length(full), length(stem)))
    meets = (r != "") & (((full != "") & (full.contains(r) | r.contains(full))) | ((stem != "") & (stem.contains(r) | r.contains(stem))))
    if forms.count() <= BROADCAST:
        pairs = spread.join(F.broadcast(forms), (spread[session] == forms[session]) & meets).drop(forms[session])
    else:
        dealt = forms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = spread.withColumn("_salt", (F.col("_i") % SALTS).cast("int")).join(dealt, [session, "_salt"]).filter(meets)
    best = pairs.groupBy(session, "_r").agg(F.min(F.col("_i") - n.cast("long") * PLACES).alias("_b")).withColumn("_i", F.pmod("_b", F.lit(PLACES)))
    best = best.join(files.select(session, "_i", "_name"), [session, "_i"]).select(session, "_r", F.col("_name").alias("file"))
    return refs.join(best, [session, "_r"], "left").select(session, position, "nth", "reference", "file").filter(F.col("file").isNotNull() | L.file_like(F.col("reference")))


def locked(items: DataFrame, session: str, control: str, position: str, file: str) -> DataFrame:
    """(session, control, files): the files of all rows that mean a control, in order, each once. Only the first place of each
    file is collected."""
    first = items.groupBy(session, control, F.col(file).alias("f")).agg(F.min(position).alias("_p"))
    return first.groupBy(session, control).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "f"))), lambda s: s["f"]).alias("files"))


def overlaps(items: DataFrame, controls: DataFrame, item: str, text: str, control: str, label: str, order: str) -> DataFrame:
    """(item, control, overlap): the control whose label shares most words with an item, the first of equals. One shared word
    is enough for an item of one or two words, others need two.

    Items of the same words have the same answer, and so have labels that share the same words with any item, of which the
    first stands for all. So each set of words of items meets each such set of labels once, by an equi-join of words, however
    many items and labels there are."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(L.spelled(F.col(c)), " "), lambda w: F.length(w) > 2)))
    a = items.select(item, F.array_join(words(text), " ").alias("_set"))
    sets = a.filter("_set <> ''").select("_set").distinct()
    each = sets.select("_set", F.explode(F.split("_set", " ")).alias("x"))
    b = controls.select(control, F.col(order).alias("_at"), F.explode(words(label)).alias("x")).join(each.select("x").distinct(), "x")
    b = b.groupBy(control, "_at").agg(F.array_join(F.array_sort(F.collect_list("x")), " ").alias("_label"))
    b = b.groupBy("_label").agg(F.max(F.struct((-F.col("_at")).alias("o"), F.col(control).alias("c"))).alias("_c"))
    hits = each.join(b.select("_label", F.explode(F.split("_label", " ")).alias("x")), "x").groupBy("_set", "_label").agg(F.count("*").alias("overlap"))
    best = hits.join(b, "_label").groupBy("_set").agg(F.max(F.struct("overlap", "_c.o", "_c.c")).alias("b"))
    least = F.when(F.size(F.split("_set", " ")) <= 2, 1).otherwise(2)
    found = a.join(best.filter(F.col("b.overlap") >= least), "_set").groupBy(item).agg(F.max("b").alias("b"))
    return found.select(item, F.col("b.c").alias(control), F.col("b.overlap").alias("overlap"))


def standard_of(framework: Column) -> Column:
    """The standard that a framework's name means; null if none is recognised."""
    f = F.lower(F.trim(F.coalesce(framework, F.lit(""))))
    return cases([(has_any(f, words), name) for name, words in L.STANDARDS.items()])


def narrowed(controls: DataFrame, standard: str, framework: str | None) -> DataFrame:
    """Controls of the framework's standard; all of them if none is named, recognised or has any."""
    spark = controls.sparkSession
    named = spark.range(1).select(standard_of(F.lit(framework)).alias("_s"))  # one row
    any_row = controls.crossJoin(F.broadcast(named)).agg(F.coalesce(F.bool_or(F.trim(standard) == F.col("_s")), F.lit(False)).alias("_any"), F.first("_s").alias("_s"))
    return controls.crossJoin(F.broadcast(any_row)).filter(~F.col("_any") | (F.trim(standard) == F.col("_s"))).drop("_any", "_s")


def cascade(items: DataFrame, controls: DataFrame, item: str, given: str, text: str, control: str, label: str, order: str, words: dict[str, str]) -> DataFrame:
    """(item, control, by): the control of each item by its stated id, else by the words of a rule, else by shared words; an
    item that nothing resolves has a null control."""
    exact = controls.select(control, F.split_part(control, F.lit(" "), F.lit(1)).alias("_id"))
    number = F.regexp_extract(F.coalesce(given, F.lit("")), r"([0-9]+\.[0-9]+)", 1)
    first = items.select(item, text, number.alias("_id")).join(F.broadcast(exact) if controls.count() <= BROADCAST else exact, "_id", "left")
    low = L.spelled(F.col(text))
    by_rule = cases([(L.has_word(low, w), c) for w, c in words.items()])
    shared = overlaps(items, controls, item, text, control, label, order).select(item, F.col(control).alias("_shared"))
    rows = first.withColumn("_rule", by_rule).join(shared, item, "left")
    how = F.when(F.col(control).isNotNull(), "id").when(F.col("_rule").isNotNull(), "rule").when(F.col("_shared").isNotNull(), "name")
    return rows.select(item, F.coalesce(control, "_rule", "_shared").alias(control), how.alias("by"))


#: Assets that chains are compared with.
ASSETS = 10_000


def chained(chains: DataFrame, assets: DataFrame, chain: str, node: str, asset: str) -> DataFrame:
    """(chain, node, asset): nodes whose name contains an asset's or is contained in it, whatever the case. Nodes repeat in many
    chains, so each name is compared once. Assets at risk are a short list and refused beyond ASSETS."""
    few = assets.select(asset).distinct()
    if few.count() > ASSETS:
        raise ValueError(f"more than {ASSETS} assets")
    names, low = chains.select(node).distinct(), F.lower
    pairs = names.join(F.broadcast(few), low(node).contains(low(asset)) | low(asset).contains(low(node)))
    return chains.select(chain, node).join(pairs, node)


# Sheets that are read before others, cells that name no file, and rows that repeat a header.
SHEETS = ("Audit Check", "Scoping", "Checklist", "Controls", "Sheet1", "Sheet 1", "Data")
NO_FILE = ("file name", "file", "filename", "n/a", "na", "-", "")
AGAIN = ("audit check", "question", "control", "sl no", "s no", "sno", "control control name", "control name")
#: Characters that a label must share to be named by its beginning.
PREFIX = 8


def read(rows: DataFrame) -> DataFrame:
    """(file, row, id_text, name_text, question, files, policy_files, evidence_files): the items of checklists.

    `rows` is (file, sheet, sheet_at, row, cells), a row of a worksheet each. Of a file the first sheet of SHEETS is read, or its
    first one. The first row with a filled cell is the header; it says which columns hold ids, names, questions and files.
    Blank rows and repeated headers are left out; a column that holds ids isn't read as questions, nor one of ids, names or
    questions as files. Null cells are blank; short rows have blank cells behind them. A file without rows has no items."""
    text = F.transform("cells", lambda c: X.stripped(F.coalesce(c, F.lit(""))))
    filled = rows.select("file", "sheet", "sheet_at", "row", text.alias("c")).filter(F.exists("c", lambda c: c != ""))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SHEETS)), F.col("sheet")), F.lit(0)), F.lit(len(SHEETS) + 1))
    # one row a file: the header of the sheet that is read
    head = rows.select("file", "sheet", "sheet_at").distinct().groupBy("file").agg(F.min_by("sheet", F.struct(rank, "sheet_at")).alias("sheet"))
    first = filled.groupBy("file", "sheet").agg(F.min_by(F.struct("row", "c"), "row").alias("h"))
    head = head.join(first, ["file", "sheet"]).select("file", "sheet", F.col("h.row").alias("top"), F.col("h.c").alias("h"))
    at = {"i": L.id_column(F.col("h")), "n": L.name_column(F.col("h")), "q": L.question_column(F.col("h"))}
    head = head.withColumns({f"_{k}": c for k, c in at.items()})
    ours = lambda i: (i != F.coalesce("_i", F.lit(-1))) & (i != F.coalesce("_n", F.lit(-1))) & (i != F.coalesce("_q", F.lit(-1)))
    role = F.transform("h", lambda h, i: F.when(L.is_file_column(h) & ours(i), L.column_role(h)))
    head = head.withColumn("roles", role)
    body = filled.join(F.broadcast(head) if head.count() <= BROADCAST else head, ["file", "sheet"]).filter(F.col("row") > F.col("top"))
    cell = lambda k: F.coalesce(F.get("c", F.col(k)), F.lit(""))
    question = F.when(F.coalesce(F.col("_q") == F.col("_i"), F.lit(False)), "").otherwise(cell("_q"))
    items = body.withColumns({"id_text": cell("_i"), "name_text": cell("_n"), "question": question})
    said = L.spelled(F.concat_ws(" ", "id_text", "name_text", "question"))
    items = items.filter((said != "") & ~said.isin(*AGAIN))
    kept = lambda roles: F.filter(F.transform("c", lambda c, i: F.when(F.get("roles", i).isin(*roles) & ~F.lower(c).isin(*NO_FILE), c)), lambda c: c.isNotNull())
    return items.select("file", "row", "id_text", "name_text", "question", kept(("policy", "evidence", "generic")).alias("files"), kept(("policy",)).alias("policy_files"), kept(("evidence",)).alias("evidence_files"))


def controls_of(items: DataFrame, controls: DataFrame, key: str, words: dict[str, str]) -> DataFrame:
    """(key, control, by): the control of each item (key, id_text, name_text, question), by its number or whole label, by the beginning of a
    label, by the words of a rule, or by shared words, in this order; what nothing resolves has a null control. `controls` is (control, label, at);
    of several the first by `at`. Labels begin with their number; a beginning counts from PREFIX characters on."""
    c = controls.select("control", "at", L.spelled(F.col("label")).alias("l"), F.regexp_extract("label", r"^\s*([0-9]+(?:\.[0-9]+)*)", 1).alias("number"))
    bare = F.when(F.col("number") != "", X.stripped(F.substr("l", F.length(L.spelled(F.col("number"))) + 1))).otherwise(F.col("l"))
    c = c.withColumn("bare", bare)
    i = items.select(F.col(key).alias("_key"), "id_text", L.spelled(F.col("name_text")).alias("n"), L.spelled(F.concat_ws(" ", "id_text", "name_text", "question")).alias("all"))
    number = i.select("_key", F.regexp_extract("id_text", r"([0-9]+(?:\.[0-9]+)+)", 1).alias("number")).filter("number <> ''")
    exact = number.join(c.filter("number <> ''"), "number").select("_key", "control", "at", F.lit(0).alias("o"))
    names = i.select("_key", F.explode(F.array_distinct(F.array("n", L.spelled(F.col("id_text"))))).alias("n")).filter("n <> ''")
    labels = c.select("control", "at", F.explode(F.array_distinct(F.array("l", "bare"))).alias("n"))
    same = names.join(labels, "n").select("_key", "control", "at", F.lit(1).alias("o"))
    heads = c.select("control", "at", F.explode(F.array_distinct(F.array("l", "bare"))).alias("x")).withColumn("p", F.left("x", F.lit(PREFIX)))
    begins = names.filter(F.length("n") >= PREFIX).withColumn("p", F.left("n", F.lit(PREFIX))).join(heads, "p").filter(F.col("x").startswith(F.col("n")))
    begins = begins.select("_key", "control", "at", F.lit(2).alias("o"))
    best = exact.unionByName(same).unionByName(begins).groupBy("_key").agg(F.min(F.struct("o", "at", "control")).alias("b"))
    by_rule = cases([(L.has_word(F.col("all"), w), k) for w, k in words.items()])
    shared = overlaps(items.select(F.col(key).alias("_key"), F.concat_ws(" ", "name_text", "question").alias("t")), controls, "_key", "t", "control", "label", "at").select("_key", F.col("control").alias("_s"))
    rows = i.withColumn("_r", by_rule).join(best, "_key", "left").join(shared, "_key", "left")
    how = F.when(F.col("b.o") == 0, "id").when(F.col("b.o") == 1, "label").when(F.col("b.o") == 2, "prefix").when(F.col("_r").isNotNull(), "rule").when(F.col("_s").isNotNull(), "name")
    return rows.select(F.col("_key").alias(key), F.coalesce("b.control", "_r", "_s").alias("control"), how.alias("by"))
