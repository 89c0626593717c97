"""Audit of a layered corpus archive: members, layers, joins, duplicates, retention, conversion, one report.

All steps are tables (``audit_tables``), whatever the number of archives and documents. The report of one archive is
made from them on the driver; it names documents and paths, so it is refused beyond ``LISTED`` of a kind. Which
documents are admitted, and to which source family a document belongs, are parameters: the engine holds no list of its own.

Layers: ``text``, ``ptb`` and ``prop``, told apart by path prefix and suffix. Every document is named by the file
without its layer suffix, through an alias table.

Defined results: an empty archive gives zero counts; documents that lack a layer are listed, not dropped; a row
failure of a document excludes the whole document; rows of the record layer are numbered as they stand, and of rows
with one (sentence, predicate) key the first is what later ones are held against.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatlas.operators import propositions, trees
from verbatlas.session import materialize, parameter_rows
from verbatlas.sources import archive as source

# Layer prefixes and suffixes, names of notices, the threshold of the conversion gate.
PREFIXES = {"text": "Propbank/MASC1_textfiles/", "ptb": "Propbank/Penn_Treebank-orig/data/", "prop": "Propbank/Propbank-orig/data/"}
SUFFIXES = {"text": r"\.txt$", "ptb": r"\.mrg(?:\.txt)?$", "prop": r"\.prop$"}
README = "Propbank/README.txt"
FRAMES = "Propbank/Propbank-orig/framefiles/"
THRESHOLD = 0.99
ALIASES = {
    "text": {"wsj_1640.mrg-NEW": "wsj_1640"},
    "ptb": {
        "sw2014-UTF16-ms98-a-trans": "sw2014-ms98-a-trans", "sw2025-ms98-a-trans.ascii-1-NEW": "sw2025-ms98-a-trans",
        "sw2071-UTF16-ms98-a-trans": "sw2071-ms98-a-trans", "sw2078-UTF16-ms98-a-trans": "sw2078-ms98-a-trans", "wsj_1640.mrg-NEW": "wsj_1640",
    },
    "prop": {
        "ENRON-pearson-email-25jul02_LU_ANNOTATE": "ENRON-pearson-email-25jul02", "enron-thread-159550_LU_ANNOTATE": "enron-thread-159550",
        "wsj_1640.prop-NEW": "wsj_1640",
    },
}

#: Documents or paths of one kind that a report may name.
LISTED = 200_000

LABEL = propositions.LABEL_FIELD
WHITE = r"[\p{Z}\t\n\x0B\f\r\x1c-\x1f\x85]+"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def classified(members: DataFrame) -> DataFrame:
    """Members with ``clean, layer, genre, document_id, unsafe, symlink, encrypted``."""
    path = F.col("path")
    clean = ~F.col("is_dir") & ~path.contains("/.svn/")
    layer = reduce(
        lambda chain, name: chain.when(path.startswith(PREFIXES[name]) & path.rlike(SUFFIXES[name]), name),
        ("ptb", "prop"),
        F.when(path.startswith(PREFIXES["text"]) & path.rlike(SUFFIXES["text"]), "text"),
    )
    rows = members.withColumn("clean", clean).withColumn("layer", F.when(F.col("clean"), layer))
    inner = F.coalesce(*(F.when(F.col("layer") == n, F.substring(path, F.lit(len(p) + 1), F.char_length(path))) for n, p in PREFIXES.items()))
    genre = F.regexp_extract(inner, r"^(spoken|written)/[^/]+$", 1)
    stem = F.coalesce(*(F.when(F.col("layer") == n, F.regexp_replace(base_name(path), s, "")) for n, s in SUFFIXES.items()))
    aliases = F.coalesce(*(F.when((F.col("layer") == n) & (F.col("_stem") == a), to) for n, table in ALIASES.items() for a, to in table.items()))
    mode = F.shiftright("external_attr", 16).bitwiseAND(F.lit(0o170000))
    return (
        rows.withColumn("genre", F.nullif(genre, F.lit("")))
        .withColumn("_stem", stem)
        .withColumn("document_id", F.coalesce(aliases, F.col("_stem")))
        .withColumn("unsafe", path.startswith("/") | path.contains("\\") | path.rlike(r"(?:^|/)\.\.(?:/|$)") | path.rlike("^[A-Za-z]:"))
        .withColumn("symlink", mode == 0o120000)
        .withColumn("encrypted", F.col("flags").bitwiseAND(F.lit(1)) == 1)
        .drop("_stem")
    )


def layer_files(rows: DataFrame) -> DataFrame:
    """``(layer, document_id, genre, path)`` of the files with a valid genre folder."""
    return rows.where("layer is not null and genre is not null").select("layer", "document_id", "genre", "path")


def layer_presence(layers: DataFrame) -> DataFrame:
    """``(document_id, layers, genres, files...)``: one row per document of any layer, by one aggregate."""
    per = layers.groupBy("document_id").agg(
        F.array_sort(F.collect_set("layer")).alias("layers"),
        F.array_sort(F.collect_set("genre")).alias("genres"),
        *(F.array_sort(F.collect_set(F.when(F.col("layer") == n, F.col("genre")))).alias(f"{n}_genres") for n in PREFIXES),
        *(F.count_if(F.col("layer") == n).alias(f"{n}_files") for n in PREFIXES),
    )
    return per.withColumn("conflict", F.size("genres") > 1)


def complete_documents(layers: DataFrame) -> DataFrame:
    """Documents that stand in all layers."""
    return layer_presence(layers).where(F.size("layers") == len(PREFIXES)).select("document_id", "genres", "conflict")


def missing_layers(layers: DataFrame) -> DataFrame:
    """``(layer, document_id)``: documents of another layer that the layer lacks."""
    every = F.explode(F.array_except(F.array(*map(F.lit, PREFIXES)), F.col("layers"))).alias("layer")
    return layer_presence(layers).select(every, "document_id")


def layer_summary(layers: DataFrame) -> DataFrame:
    return layers.groupBy("layer").agg(
        F.count("*").alias("files"),
        F.count_distinct("document_id").alias("canonical_documents"),
        F.count_if(F.col("genre") == "spoken").alias("spoken_files"),
        F.count_if(F.col("genre") == "written").alias("written_files"),
        F.count_if(F.lower("document_id").startswith("wsj_")).alias("wsj_files"),
    )


def non_blank_lines(df: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``(keys, line_no, row)``: the lines of a text that are not blank, stripped."""
    lines = df.select(*keys, F.posexplode(F.split(text_col, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]")).alias("line_no", "l"))
    stripped = F.regexp_replace(F.regexp_replace("l", f"^{WHITE}", ""), f"{WHITE}$", "")
    return lines.select(*keys, "line_no", stripped.alias("row")).where("row <> ''")


def local_kind(row: Column) -> Column:
    """``a``, ``n`` or ``v`` of a typed archive row, else ``classic``."""
    fields = F.split(row, WHITE)
    typed = F.regexp_extract(F.coalesce(F.try_element_at(fields, F.lit(4)), F.lit("")), r"^.+-([anv])$", 1)
    return F.when((F.try_element_at(fields, F.lit(6)) == "-----") & (typed != ""), typed).otherwise("classic")


def local_records(rows: DataFrame) -> DataFrame:
    """Archive rows (without document field) with ``kind, dialect, sentence_index, predicate_index, n_rel, row_error``."""
    fields = F.split("row", WHITE)
    field = lambda i: F.try_element_at(fields, F.lit(i + 1))
    number = lambda i: F.when(F.coalesce(field(i).rlike(r"^[+-]?[0-9]+$"), F.lit(False)), F.coalesce(field(i).try_cast("int"), F.lit(2147483647)))
    dotted = lambda i: F.coalesce(field(i).contains("."), F.lit(False))
    n = F.size(fields)
    modern = (n >= 7) & F.coalesce(field(3).rlike(r"^.+-[anv]$"), F.lit(False)) & dotted(4) & (field(5) == "-----")
    classic = (n >= 6) & dotted(3) & (F.char_length(field(4)) == 5)
    kind = local_kind(F.col("row"))
    marked = rows.withColumns({"kind": kind, "_n": n, "_modern": F.coalesce(modern, F.lit(False)), "_classic": F.coalesce(classic, F.lit(False)), "sentence_index": number(0), "predicate_index": number(1)})
    label_fields = F.when(F.col("_modern"), F.slice(fields, 7, F.greatest(n - 6, F.lit(0)))).otherwise(F.slice(fields, 6, F.greatest(n - 5, F.lit(0))))
    rel_fields = F.slice(fields, F.when(F.col("kind") == "classic", 6).otherwise(7), F.greatest(n, F.lit(0)))
    rel = lambda a: F.size(F.filter(a, lambda f: F.regexp_extract(f, LABEL, 2) == "rel"))
    error = (
        F.when(F.col("sentence_index").isNull() | F.col("predicate_index").isNull(), "record_fixed_fields_invalid")
        .when((F.col("sentence_index") < 0) | (F.col("predicate_index") < 0), "record_index_negative")
        .when(~F.col("_modern") & ~F.col("_classic"), "record_fixed_fields_invalid")
        .when((F.size(label_fields) == 0) | F.exists(label_fields, lambda f: ~f.rlike(LABEL)), "record_label_field_invalid")
        .when(rel(label_fields) != 1, "record_rel_count_invalid")
    )
    return marked.withColumns({"row_error": error, "n_rel": rel(rel_fields), "dialect": F.when(F.col("kind") == "classic", "classic").otherwise("modern")}).drop("_n", "_modern", "_classic")


def duplicate_predicates(rows: DataFrame, key: Sequence[str], order: str, raw: str) -> DataFrame:
    """Adds ``duplicate``: ``exact`` or ``conflicting`` for rows that are not the first of their key."""
    window = Window.partitionBy(*key).orderBy(order)
    first, number = F.first_value(raw).over(window), F.row_number().over(window)
    present = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
    return rows.withColumn("duplicate", F.when(present & (number > 1), F.when(first == F.col(raw), "exact").otherwise("conflicting")))


def selected_records(prop_files: DataFrame) -> DataFrame:
    """``(document_id, path, alternates, ambiguous, text)``: the record file of each document.

    Of identical files the one without annotation mark and with the first name is taken; different files make the
    document ambiguous (no path).
    """
    per = prop_files.groupBy("document_id").agg(
        F.count("*").alias("n"),
        F.count_distinct(F.sha2(F.encode("text", "utf-8"), 256)).alias("contents"),
        F.min(F.struct(F.col("path").contains("_LU_ANNOTATE").alias("marked"), "path", "text")).alias("best"),
    )
    clear = F.col("contents") == 1
    return per.select(
        "document_id", F.when(clear, F.col("best.path")).alias("path"), F.when(clear, F.col("n") - 1).otherwise(0).alias("alternates"),
        (~clear).alias("ambiguous"), F.when(clear, F.col("best.text")).alias("text"),
    )


def join_reason(rows: DataFrame) -> Column:
    """Why a row meets no tree; ``has_text``, ``counts`` (terminals per sentence), indexes and ``row_error`` given."""
    counts = F.col("counts")
    return (
        F.when(F.col("sentence_index").isNull() | F.col("predicate_index").isNull(), "record_fixed_fields_invalid")
        .when(~F.col("has_text") & counts.isNull(), "text_and_ptb_document_missing_or_invalid")
        .when(~F.col("has_text"), "text_document_missing")
        .when(counts.isNull(), "ptb_document_missing_or_invalid")
        .when((F.col("sentence_index") < 0) | (F.col("sentence_index") >= F.size(counts)), "sentence_index_out_of_range")
        .when((F.col("predicate_index") < 0) | (F.col("predicate_index") >= F.try_element_at(counts, F.col("sentence_index") + 1)), "predicate_terminal_out_of_range")
    )


def annotation_inventory(rows: DataFrame) -> DataFrame:
    """``(item, n)`` over archive rows: dialects, types, labels, operators and their combinations per row."""
    fields = F.split("row", WHITE)
    modern = F.coalesce(F.try_element_at(fields, F.lit(6)) == "-----", F.lit(False))
    start = F.when(modern, 7).otherwise(6)
    base = rows.select(modern.alias("m"), local_kind(F.col("row")).alias("kind"), F.slice(fields, start, F.greatest(F.size(fields), F.lit(1))).alias("f"))

    def items_of(f: Column) -> Column:
        pointer, label = F.regexp_extract(f, LABEL, 1), F.regexp_extract(f, LABEL, 2)
        bad = ~f.rlike(LABEL)
        kind = F.when(bad, "unparsed_label_fields").when(label.startswith("LINK-"), F.concat(F.lit("link_"), label)).when(
            label.startswith("C-"), "continuation_labels").when(label.startswith("R-"), "reference_labels")
        operators = [F.when(~bad & pointer.contains(o), f"pointer_fields_{n}") for o, n in ((",", "comma"), (";", "semicolon"), ("*", "star"))]
        return F.array(kind, *operators, F.when((label == "rel") & pointer.rlike("[,;*]"), "multi_pointer_predicates"))

    all_items = F.flatten(F.transform("f", items_of))
    used = lambda n: F.array_contains(all_items, f"pointer_fields_{n}")
    names = F.concat_ws("+", *(F.when(F.coalesce(used(n), F.lit(False)), n) for n in ("comma", "semicolon", "star")))
    row_items = F.array(
        F.when(F.col("m"), "dialect_modern").otherwise("dialect_classic"),
        F.when(F.col("m"), F.concat(F.lit("predicate_type_"), F.col("kind"))),
        F.concat(F.lit("records_"), F.when(names == "", "simple").otherwise(names)),
    )
    return base.select(F.explode(F.concat(row_items, all_items)).alias("item")).where("item is not null").groupBy("item").agg(F.count("*").alias("n"))


def structural_findings(records: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row of counts: arguments without words, linked or not, and records that have them. ``records`` are
    parsed and without error, ``sentences`` are trees."""
    key = ["document_id", "sentence_index"]
    joined = records.join(sentences.where("tree_error is null").select(*key, "nodes", "terminals"), key)
    nodes, terminals = F.col("nodes"), F.col("terminals")
    argument = lambda v: (v["label"] != "rel") & ~v["label"].startswith("LINK-")
    own = lambda v: F.flatten(F.transform(v["members"], lambda m: m["nodes"]))
    links = F.flatten(F.transform(F.filter("labels", lambda v: v["label"].startswith("LINK-")), own))

    def finding(v: Column) -> Column:
        flat = propositions.resolve_nodes(own(v), nodes, terminals)

        def judge(r: Column) -> Column:
            bare = ~F.exists(r, lambda x: x["error"].isNotNull()) & ~F.exists(r, lambda x: F.size(x["surface"]) > 0)
            linked = F.size(F.array_intersect(own(v), links)) > 0
            pro = F.exists(r, lambda x: F.exists(F.slice(terminals, F.greatest(x["lt"] + 1, F.lit(1)), x["nt"]), lambda t: t["word"] == "*PRO*"))
            return F.struct(bare.alias("bare"), (bare & linked).alias("linked"), (bare & ~linked).alias("unlinked"), (bare & ~linked & F.coalesce(pro, F.lit(False))).alias("pro"))

        return F.element_at(F.transform(F.array(flat), judge), 1)

    found = joined.select(F.transform(F.filter("labels", argument), finding).alias("a"))
    count = lambda n: F.size(F.filter("a", lambda x: x[n]))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return found.agg(
        F.count("*").alias("records_examined"), total(count("bare")).alias("no_surface_arguments"), total(count("linked")).alias("linked_no_surface_arguments"),
        total(count("unlinked")).alias("unlinked_no_surface_arguments"), F.count_if(count("bare") > 0).alias("records_with_no_surface"),
        F.count_if(count("unlinked") > 0).alias("records_with_unlinked_no_surface"), F.count_if(count("pro") > 0).alias("records_with_unlinked_unindexed_pro"),
    )


def safety_facts(rows: DataFrame) -> DataFrame:
    """One row of counts over classified members: files, sizes, and everything that makes an archive unsafe."""
    file = ~F.col("is_dir")
    return rows.agg(
        F.count("*").alias("entries"), F.count_if(file).alias("files"), F.count_if(file & F.col("clean")).alias("clean_files"),
        F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("uncompressed_bytes"), F.coalesce(F.sum(F.when(file, F.col("compressed"))), F.lit(0)).alias("compressed_bytes"),
        F.count_if(file & F.col("unsafe")).alias("unsafe"), F.count_if(file & F.col("symlink")).alias("symlinks"), F.count_if(file & F.col("encrypted")).alias("encrypted"),
        F.count_if(file & ~F.coalesce("crc_ok", F.lit(True))).alias("damaged"), (F.count("*") - F.count_distinct("path")).alias("duplicate_names"),
        (F.count("*") - F.count_distinct(F.lower("path"))).alias("casefold_collisions"), F.coalesce(F.max(F.col("path") == README), F.lit(False)).alias("readme_present"),
    )


def problem_paths(rows: DataFrame) -> DataFrame:
    """``(problem, path)`` of members that are unsafe, symbolic links, encrypted, damaged, or of no valid genre."""
    file = ~F.col("is_dir")
    kinds = {
        "unsafe": file & F.col("unsafe"), "symlink": file & F.col("symlink"), "encrypted": file & F.col("encrypted"), "damaged": file & ~F.coalesce("crc_ok", F.lit(True)),
        "invalid_genre": F.col("layer").isNotNull() & F.col("genre").isNull(),
    }
    found = F.array(*(F.when(test, F.lit(name)) for name, test in kinds.items()))
    return rows.select(F.explode(found).alias("problem"), "path").where("problem is not null")


def notices(rows: DataFrame) -> DataFrame:
    """``(notice, path)`` of legal notices: of the archive, or of frame files."""
    stem = F.lower(F.regexp_replace(base_name(F.col("path")), r"(?<!^)\.[^.]*$", ""))
    in_frames = F.col("path").startswith(FRAMES)
    kind = F.when(~in_frames & stem.isin("copying", "license", "notice"), "archive").when(in_frames & stem.rlike("^(?:copying|license|notice)-[anv]$"), "frame")
    return rows.where("clean").select(kind.alias("notice"), "path").where("notice is not null")


def suffix_counts(rows: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract(base_name(F.col("path")), r"(?<!^)(\.[^.]+)$", 1))
    return rows.where("clean").groupBy(F.when(suffix == "", "<none>").otherwise(suffix).alias("suffix")).agg(F.count("*").alias("files"))


def duplicate_names(layers: DataFrame) -> DataFrame:
    """``(layer, document_id, names)`` of documents with several files in a layer."""
    return layers.groupBy("layer", "document_id").agg(F.array_sort(F.collect_list(base_name(F.col("path")))).alias("names")).where(F.size("names") > 1)


def is_wsj(document: str = "document_id") -> Column:
    return F.lower(document).startswith("wsj_")


def audit_tables(members: DataFrame, allowed: DataFrame, families: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the audit from the members of archives.

    ``allowed`` has the admitted ``document_id``, ``families`` the ``document_id`` and ``family`` of documents.

    ``rows`` (classified members), ``layers``, ``presence``, ``physical`` (dialects of all record rows), ``chosen`` (record files),
    ``scan`` (balanced trees), ``full`` (records with the reason why they meet no tree), ``eligible``, ``broken``, ``candidates``,
    ``failed`` (rows that exclude their document), ``exclusions`` (document, reasons, rows), ``retained``, ``records``,
    ``converted``, ``findings``, ``rights`` (family and disposition of every document).
    """
    made: dict[str, DataFrame] = {}
    asked = allowed.where("document_id is not null").select("document_id").distinct()
    denied, admitted = asked.where(is_wsj()), asked.where(~is_wsj())
    rows = made["rows"] = materialize(classified(members), "members")
    layers = made["layers"] = layer_files(rows)
    presence = made["presence"] = materialize(layer_presence(layers), "presence")
    texts = materialize(source.decoded(rows.where("layer in ('ptb', 'prop') and genre is not null").select("layer", "document_id", "path", "content")), "layer-texts")
    prop_files = texts.where("layer = 'prop'")
    chosen = made["chosen"] = materialize(selected_records(prop_files.select("document_id", "path", "text")), "chosen")
    made["physical"] = non_blank_lines(prop_files, "text", "document_id", "path").select(F.when(local_kind(F.col("row")) == "classic", "classic").otherwise("modern").alias("dialect"))

    ptb = texts.where("layer = 'ptb'").join(presence.select("document_id", "ptb_files"), "document_id")
    counted = trees.balanced_counts(ptb.where("ptb_files = 1"), "text", "document_id")
    several = ptb.where("ptb_files > 1").select("document_id", F.lit(None).cast("int").alias("sentences"), F.lit(None).cast("array<int>").alias("terminals"), F.lit("ambiguous_ptb_path").alias("tree_error")).distinct()
    scan = made["scan"] = materialize(counted.unionByName(several), "scan")
    records = local_records(non_blank_lines(chosen.where("path is not null"), "text", "document_id"))
    records = duplicate_predicates(records, ["document_id", "sentence_index", "predicate_index"], "line_no", "row")
    joined = records.join(scan.where("tree_error is null").select("document_id", F.col("terminals").alias("counts")), "document_id", "left").join(
        presence.select("document_id", F.array_contains("layers", "text").alias("has_text")), "document_id", "left"
    )
    full = made["full"] = materialize(joined.withColumn("reason", join_reason(joined)).withColumn("wsj", is_wsj()), "full-join")

    # retention: the documents of the manifest that have all layers, and their rows against parsed trees
    manifest = admitted.join(presence, "document_id", "left")
    lacking = F.explode(F.array_except(F.array(*map(F.lit, PREFIXES)), F.coalesce("layers", F.array().cast("array<string>")))).alias("l")
    reasons = manifest.select("document_id", lacking).select("document_id", F.concat("l", F.lit("_layer_missing")).alias("reason"))
    reasons = reasons.unionByName(manifest.where("conflict").select("document_id", F.lit("cross_layer_genre_conflict").alias("reason")))
    complete = made["complete"] = manifest.where(F.size("layers") == len(PREFIXES))
    eligible = complete.join(reasons, "document_id", "left_anti").join(chosen.select("document_id", "path"), "document_id", "left")
    ambiguous = F.when(F.col("path").isNull(), "prop_path_ambiguous").when((F.col("ptb_files") != 1) | (F.col("text_files") != 1), "layer_path_ambiguous")
    eligible = made["eligible"] = materialize(eligible.withColumn("ambiguous", ambiguous).select("document_id", "ambiguous"), "eligible")
    parsed = trees.parse_trees(ptb.join(eligible.where("ambiguous is null").select("document_id"), "document_id", "left_semi"), "text", "document_id")
    sentences = made["sentences"] = materialize(parsed.withColumnRenamed("tree_no", "sentence_index"), "sentences")
    broken = made["broken"] = sentences.where("tree_error is not null").select("document_id", F.col("tree_error").alias("code"))
    sizes = sentences.where("tree_error is null").groupBy("document_id").agg(F.count("*").alias("n_trees"))
    candidates = records.join(sizes, "document_id").join(
        sentences.select("document_id", "sentence_index", F.size("terminals").alias("n_terminals")), ["document_id", "sentence_index"], "left"
    )
    row_reason = F.coalesce(
        "row_error",
        F.when(F.col("sentence_index") >= F.col("n_trees"), "sentence_index_out_of_range"),
        F.when(F.col("predicate_index") >= F.col("n_terminals"), "predicate_terminal_out_of_range"),
    )
    valid = made["candidates"] = materialize(candidates.drop("duplicate").withColumn("reason", row_reason), "candidates")
    again = duplicate_predicates(valid.where("reason is null"), ["document_id", "sentence_index", "predicate_index"], "line_no", "row")
    failed = valid.where("reason is not null").select("document_id", "reason").unionByName(
        again.where("duplicate is not null").select("document_id", F.concat("duplicate", F.lit("_duplicate_predicate")).alias("reason"))
    )
    failed = made["failed"] = materialize(failed, "row-failures")
    reasons = reasons.unionByName(eligible.where("ambiguous is not null").select("document_id", F.col("ambiguous").alias("reason")))
    reasons = reasons.unionByName(broken.select("document_id", F.concat(F.lit("ptb_"), F.col("code")).alias("reason"))).unionByName(failed)
    reasons = materialize(reasons.unionByName(denied.select("document_id", F.lit("wsj_denied_override").alias("reason"))), "reasons")
    row_counts = full.groupBy("document_id").agg(F.count("*").alias("n"))
    made["exclusions"] = reasons.groupBy("document_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons")).join(row_counts, "document_id", "left").select(
        "document_id", "reasons", F.coalesce("n", F.lit(0)).alias("n"))
    retained = made["retained"] = materialize(valid.join(reasons.select("document_id"), "document_id", "left_anti"), "retained")

    # conversion of the retained rows that are verbal or classic; all their documents are admitted
    verbal = retained.where("kind in ('v', 'classic')").select(F.concat_ws(" ", "document_id", "row").alias("line"))
    made["records"] = materialize(propositions.parse_records(verbal), "parsed-records")
    made["converted"] = propositions.conversion_rows(made["records"], sentences)
    made["findings"] = structural_findings(made["records"].where("record_error is null"), sentences)
    listed = presence.select("document_id")
    family = listed.join(families, "document_id", "left") if families is not None else listed.withColumn("family", F.lit(None).cast("string"))
    disposition = F.when(is_wsj(), "deny").when(F.col("admitted"), "diagnostic").otherwise("hold")
    made["rights"] = family.join(admitted.withColumn("admitted", F.lit(True)), "document_id", "left").select(
        "document_id", F.when(is_wsj(), "Wall Street Journal").otherwise(F.coalesce("family", F.lit("Unmapped"))).alias("family"), disposition.alias("disposition")
    )
    return made


def gates_of(facts: Mapping, pinned: bool, excluded: int, retained: int, coverage: float) -> dict[str, bool]:
    """Which gates are passed; the one of rights never is without a complete manifest."""
    safe = not any(facts[k] for k in ("unsafe", "symlinks", "encrypted", "damaged", "duplicate_names", "casefold_collisions"))
    return {"acquisition_pin": pinned, "archive_safety": safe, "g1_rights": False, "g2_join": retained > 0 and not excluded, "g3_annotation_fit": coverage >= THRESHOLD}


def decision_of(gates: Mapping[str, bool]) -> str:
    """The reason of the decision: the first gate that blocks, or that several fits do."""
    open_fits = [g for g in ("g1_rights", "g2_join", "g3_annotation_fit") if not gates[g]]
    if not gates["acquisition_pin"]:
        return "archive_pin_mismatch"
    if not gates["archive_safety"]:
        return "archive_safety_check_failed"
    if len(open_fits) > 1:
        return "multiple_feasibility_gates_failed"
    names = {"g1_rights": "rights_gate_incomplete", "g2_join": "retained_subset_join_gate_failed", "g3_annotation_fit": "gold_span_conversion_below_predeclared_threshold"}
    return names[open_fits[0]] if open_fits else "all_preparation_gates_met"


def listed(df: DataFrame, *order: str) -> list:
    """The rows that a report names, in order; more than ``LISTED`` are an error, never cut."""
    return parameter_rows(df.orderBy(*order), LISTED)


def counts_of(df: DataFrame, key: str) -> dict:
    """A small grouped count as a dict in order of its keys."""
    return {r[0]: r[1] for r in listed(df.groupBy(key).agg(F.count("*").alias("n")), key)}


def audit_archive(
    spark: SparkSession,
    path: str,
    allowed: Sequence[str],
    families: Mapping[str, str] | None = None,
    pin: tuple[str, int, str] | None = None,
    allow_unpinned: bool = False,
) -> dict:
    """The whole report. ``allowed`` are the admitted documents, ``families`` maps documents to source families,
    ``pin`` is (file name, bytes, sha256) of the expected file; another file is an error unless allowed."""
    name, size, digest = source.fingerprint(path)
    match = source.check_pin(path, *pin) if pin else dict.fromkeys(("filename", "bytes", "sha256"), False)
    pinned = all(match.values())
    if not pinned and not allow_unpinned:
        raise ValueError("the archive does not match the pinned file name, size and SHA-256")
    manifest = spark.createDataFrame([(d,) for d in allowed], "document_id string")
    mapped = spark.createDataFrame(list((families or {}).items()), "document_id string, family string")
    t = audit_tables(source.read_archive(spark, path), manifest, mapped)
    rows, presence, full, failed, retained, chosen = (t[k] for k in ("rows", "presence", "full", "failed", "retained", "chosen"))
    facts = safety_facts(rows).first()
    problems: dict[str, list[str]] = {}
    for r in listed(problem_paths(rows), "path"):
        problems.setdefault(r.problem, []).append(r.path)
    bad = rows.where("not is_dir").agg(F.min_by("path", F.when(~F.col("crc_ok"), F.col("position")))).first()[0]
    legal = listed(notices(rows), "path")

    outcome = {r[0]: r[1] for r in t["converted"].groupBy("reason_code").agg(F.count("*")).collect()}
    n_verbal, n_retained = t["records"].count(), retained.count()
    n_converted, failures = outcome.pop(None, 0), dict(sorted(outcome.items()))
    if n_converted + sum(failures.values()) != n_verbal:
        raise RuntimeError("conversion counts do not reconcile")
    findings = t["findings"].first().asDict()
    coverage = n_converted / n_verbal if n_verbal else 0.0
    ceiling = (n_verbal - findings["records_with_unlinked_unindexed_pro"]) / n_verbal if n_verbal else 0.0

    excluded = listed(t["exclusions"], "document_id")
    n_docs = retained.select("document_id").distinct().count()
    gates = gates_of(facts, pinned, len(excluded), n_docs, coverage)
    blocking = [gate for gate, passed in gates.items() if not passed]
    union = presence.select("document_id", is_wsj().alias("wsj"), (F.size("layers") == 3).alias("all"), "conflict", "genres", *(f"{n}_genres" for n in PREFIXES))
    u = union.agg(F.count("*").alias("n"), F.count_if("wsj").alias("wsj"), F.count_if("all").alias("all"), F.count_if(F.expr("all and not wsj")).alias("all_other")).first()
    fj = full.agg(F.count("*").alias("n"), F.count_if(F.expr("reason is null")).alias("j"), F.count_if(F.expr("not wsj")).alias("o"), F.count_if(F.expr("not wsj and reason is null")).alias("oj"), F.count_if(F.expr("n_rel <> 1")).alias("rel"),
                  F.count_if(F.expr("duplicate = 'exact'")).alias("ex"), F.count_if(F.expr("duplicate = 'conflicting'")).alias("co")).first()
    scanned = t["scan"].where("tree_error is null").agg(F.count("*").alias("d"), F.coalesce(F.sum("sentences"), F.lit(0)).alias("s")).first()
    docs = lambda df: [r[0] for r in listed(df.select("document_id").distinct(), "document_id")]
    missing: dict[str, list[str]] = {n: [] for n in PREFIXES}
    for layer, document in listed(missing_layers(t["layers"]), "layer", "document_id"):
        missing[layer].append(document)
    duplicates: dict[str, dict[str, list[str]]] = {n: {} for n in PREFIXES}
    for layer, document, names in listed(duplicate_names(t["layers"]), "layer", "document_id"):
        duplicates[layer][document] = names
    summary = {r.layer: {k: r[k] for k in ("files", "canonical_documents", "spoken_files", "written_files", "wsj_files")} for r in layer_summary(t["layers"]).collect()}
    empty_layer = dict.fromkeys(("files", "canonical_documents", "spoken_files", "written_files", "wsj_files"), 0)
    alternate = (
        non_blank_lines(chosen.where("alternates > 0"), "text", "document_id", "alternates").agg(F.coalesce(F.sum("alternates"), F.lit(0))).first()[0]
    )
    denied = sorted({d for d in allowed if d.casefold().startswith("wsj_")})
    return {
        "acquisition": {"filename": name, "bytes": size, "sha256": digest, **{f"matches_pinned_{k}": v for k, v in match.items()}},
        "archive": {
            "status": "pass" if gates["archive_safety"] else "fail", "entries": facts.entries, "files": facts.files, "clean_files": facts.clean_files, "svn_files_ignored": facts.files - facts.clean_files,
            "uncompressed_bytes": facts.uncompressed_bytes, "compressed_member_bytes": facts.compressed_bytes, "member_compression_ratio": facts.uncompressed_bytes / facts.compressed_bytes if facts.compressed_bytes else None,
            "crc_error_member": bad, "unsafe_paths": problems.get("unsafe", []), "symlinks": problems.get("symlink", []), "encrypted_files": problems.get("encrypted", []), "duplicate_entry_names": facts.duplicate_names,
            "casefold_name_collisions": facts.casefold_collisions, "readme_present": facts.readme_present, "archive_level_legal_notice_files": [r.path for r in legal if r.notice == "archive"],
            "frame_legal_notice_files": [r.path for r in legal if r.notice == "frame"], "suffix_counts": {r.suffix: r.files for r in listed(suffix_counts(rows), "suffix")},
        },
        "layers": {n: summary.get(n, empty_layer) for n in PREFIXES},
        "join": {
            "canonical_union_documents": u.n, "all_three_layer_documents": u["all"], "all_three_layer_non_wsj_documents": u.all_other, "wsj_union_documents": u.wsj, "missing_by_layer": missing,
            "invalid_genre_paths": problems.get("invalid_genre", []),
            "cross_layer_genre_conflicts": {r.document_id: {n: r[f"{n}_genres"] for n in PREFIXES} for r in listed(union.where("conflict"), "document_id")},
            "canonical_document_genre_counts": counts_of(union.where("not conflict").select(F.element_at("genres", 1).alias("g")), "g"),
            "duplicate_canonical_paths": duplicates, "identical_alternate_prop_rows": alternate, "ambiguous_prop_documents": docs(chosen.where("ambiguous")),
            "physical_prop_rows": t["physical"].count(), "physical_prop_dialects": counts_of(t["physical"], "dialect"), "canonical_prop_rows": fj.n, "canonical_prop_dialects": counts_of(full, "dialect"),
            "ptb_structurally_valid_documents": scanned.d, "ptb_structural_failure_documents": {r.document_id: r.tree_error for r in listed(t["scan"].where("tree_error is not null"), "document_id")},
            "ptb_structurally_valid_sentences": scanned.s, "full_joined_prop_rows": fj.j, "full_join_failures": counts_of(full.where("reason is not null"), "reason"), "non_wsj_canonical_prop_rows": fj.o,
            "non_wsj_fully_joined_prop_rows": fj.oj, "rows_without_exactly_one_rel": fj.rel, "exact_duplicate_predicate_instances": fj.ex, "conflicting_duplicate_predicate_instances": fj.co,
            "conflicting_duplicate_predicate_documents": docs(full.where("duplicate = 'conflicting'")),
        },
        "rights": {
            "status": "incomplete_provisional_diagnostic_manifest", "requested_allowed_documents": len(set(allowed)), "effective_allowed_documents": len(set(allowed)) - len(denied), "denied_override_documents": denied,
            "joined_allowed_documents": t["complete"].count(), "source_family_union_counts": counts_of(t["rights"], "family"), "disposition_union_counts": counts_of(t["rights"], "disposition"), "wsj_policy": "deny_all_layers",
        },
        "g2": {
            "status": "pass" if gates["g2_join"] else "fail", "candidate_joined_documents": t["complete"].count(), "retained_documents": n_docs, "candidate_rows_after_tree_parse": t["candidates"].count(), "retained_rows": n_retained,
            "exclusions": {r.document_id: {"reasons": r.reasons, "canonical_prop_rows": r.n} for r in excluded}, "excluded_documents": len(excluded), "excluded_canonical_prop_rows": sum(r.n for r in excluded),
            "tree_failure_documents": {r.document_id: r.code for r in listed(t["broken"], "document_id")}, "tree_failure_reasons": counts_of(t["broken"], "code"), "ambiguous_prop_documents": docs(t["eligible"].where("ambiguous is not null")),
            "row_failures": counts_of(failed, "reason"), "exact_duplicate_predicate_instances": failed.where("reason = 'exact_duplicate_predicate'").count(),
            "conflicting_duplicate_predicate_instances": failed.where("reason = 'conflicting_duplicate_predicate'").count(),
        },
        "g3": {
            "status": "pass" if gates["g3_annotation_fit"] else "fail", "threshold": THRESHOLD, "eligible_verbal_records": n_verbal, "nonverbal_records_excluded": n_retained - n_verbal, "converted_records": n_converted,
            "conversion_failures": failures, "conversion_coverage": coverage, "annotation_inventory": {r.item: r.n for r in annotation_inventory(retained).orderBy("item").collect()},
            "structural_findings": {k: v for k, v in sorted(findings.items()) if v}, "optimistic_exact_span_ceiling": ceiling,
        },
        "decision": {"overall": "no_go" if blocking else "go", "reason": decision_of(gates), "blocking_gates": blocking},
    }
