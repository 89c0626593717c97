"""Stand-off proposition records, their pointers, and their conversion to word-level BIO examples.

Records and trees meet in one equi-join on (document, sentence). Everything else is expressions over the arrays of
one record: a pointer ``t:h`` selects the node with ``lt = t`` and ``level = level of terminal t - h``. Every check
yields a code where it fails, and the codes are ordered as the checks are, so the first one that applies is the
reason of the record; a failing record is a row with a reason, never a failed job, and converted plus rejected rows
are all rows.

Defined results: null and blank lines have ``record_empty``; indexes are decimal digits with an optional plus sign;
records without a tree have ``sentence_index_out_of_range``, records of a bad tree its code; repeated records are
converted each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.operators.text import computed_once
from verbatlas.operators.trees import surface_words

# Eligible predicate tags, link labels, and the patterns of the record format.
VERBAL_TAGS = ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ")
LINK_LABELS = ("LINK-PCR", "LINK-PRO", "LINK-PSV", "LINK-SLC")
LABEL_FIELD = r"^([0-9]+:[0-9]+(?:[,;*][0-9]+:[0-9]+)*)-(.+)$"
POINTER = r"^[0-9]+:[0-9]+(?:[,;*][0-9]+:[0-9]+)*$"
TYPED_LEMMA = r"^(.+)-([anv])$"
CORE_ROLE = r"^((?:C-|R-)?)(ARG(?:[0-9]+|A))(?:-([A-Za-z0-9][A-Za-z0-9_.-]*))?$"
MODIFIER_ROLE = r"^((?:C-|R-)?)ARGM-([A-Za-z0-9][A-Za-z0-9_.-]*)$"
BARE_MODIFIER = ("ARGM", "C-ARGM", "R-ARGM")

MEMBERS = "array<struct<nodes:array<struct<t:int,h:int>>,operator:string>>"


def pointer_error(raw: Column) -> Column:
    """The code of a pointer text, null if it is well formed."""
    has = raw.contains
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "pointer_empty")
        .when(has(";") & has("*"), "mixed_semicolon_chain_unsupported")
        .when(has(";") & has(","), "mixed_concatenation_unsupported")
        .when(~raw.rlike(POINTER), "pointer_syntax_invalid")
    )


def pointer_members(raw: Column) -> Column:
    """``array<struct<nodes array<struct<t, h>>, operator>>`` of a well-formed pointer.

    Numbers beyond the range of an int point outside every tree and are kept as the largest int.
    """

    def number(text: Column) -> Column:
        return F.coalesce(text.try_cast("int"), F.lit(2147483647))

    def node(text: Column) -> Column:
        pair = F.split(text, ":")
        return F.struct(number(pair[0]).alias("t"), number(pair[1]).alias("h"))

    def member(text: Column) -> Column:
        operator = F.when(text.contains(","), ",").when(text.contains(";"), ";")
        return F.struct(F.transform(F.split(text, "[,;]"), node).alias("nodes"), operator.alias("operator"))

    return F.transform(F.split(raw, r"\*"), member)


def parse_pointers(df: DataFrame, raw_col: str) -> DataFrame:
    """Adds ``members`` and ``pointer_error``."""
    error = pointer_error(F.col(raw_col))
    return df.withColumn("pointer_error", error).withColumn("members", F.when(error.isNull(), pointer_members(F.col(raw_col))))


def role_error(label: Column) -> Column:
    return F.when(label.rlike(CORE_ROLE) | label.rlike(MODIFIER_ROLE), F.lit(None).cast("string")).when(
        label.isin(*BARE_MODIFIER), "argm_feature_missing"
    ).otherwise("unsupported_role")


def model_label(label: Column) -> Column:
    """The label that models see: a feature of a numbered role is dropped, that of a modifier is kept."""
    core = F.concat(F.regexp_extract(label, CORE_ROLE, 1), F.regexp_extract(label, CORE_ROLE, 2))
    return F.when(label.rlike(CORE_ROLE), core).when(label.rlike(MODIFIER_ROLE), label)


def role_feature(label: Column) -> Column:
    core = F.nullif(F.regexp_extract(label, CORE_ROLE, 3), F.lit(""))
    return F.when(label.rlike(CORE_ROLE), core).when(label.rlike(MODIFIER_ROLE), F.regexp_extract(label, MODIFIER_ROLE, 2))


def parse_records(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds the fields of a record and ``record_error``.

    ``document_id, sentence_index, predicate_terminal, annotator, roleset, dialect, lemma, kind, inflection,
    labels array<struct<label, raw, members>>, raw_line``.
    """
    white = r"[\p{Z}\t\n\x0B\f\r\x1c-\x1f\x85]+"
    stripped = F.regexp_replace(F.regexp_replace(F.coalesce(line_col, F.lit("")), f"^{white}", ""), f"{white}$", "")
    rows = computed_once(df, "raw_line", stripped)
    rows = computed_once(rows, "_f", F.when(F.col("raw_line") == "", F.array().cast("array<string>")).otherwise(F.split("raw_line", white)))
    field = lambda i: F.try_element_at("_f", F.lit(i + 1))
    n = F.size("_f")
    typed = F.coalesce(field(4).rlike(TYPED_LEMMA), F.lit(False))
    index = lambda i: F.when(field(i).rlike(r"^\+?[0-9]+$"), F.coalesce(field(i).try_cast("int"), F.lit(2147483647)))
    rest = F.when(typed, F.slice("_f", 8, F.greatest(n - 7, F.lit(0)))).otherwise(F.slice("_f", 7, F.greatest(n - 6, F.lit(0))))
    rows = rows.withColumns(
        {"_typed": typed, "_rest": F.when(n >= 7, rest).otherwise(F.array().cast("array<string>")), "_roleset": F.when(typed, field(5)).otherwise(field(4))}
    )

    def label_of(text: Column) -> Column:
        raw = F.regexp_extract(text, LABEL_FIELD, 1)
        error = F.when(~text.rlike(LABEL_FIELD), "proposition_label_invalid").otherwise(pointer_error(raw))
        members = F.when(error.isNull(), pointer_members(raw))
        return F.struct(F.regexp_extract(text, LABEL_FIELD, 2).alias("label"), raw.alias("raw"), members.alias("members"), error.alias("error"))

    rows = computed_once(rows, "_labels", F.transform("_rest", label_of))
    labels = F.col("_labels")
    first_label_error = F.try_element_at(F.filter(F.transform(labels, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(1))
    classic = ~F.col("_typed")
    error = F.coalesce(
        F.when(n == 0, "record_empty"),
        F.when(n < 7, "record_field_count_invalid"),
        F.when(index(1).isNull() | index(2).isNull(), "record_index_invalid"),
        F.when(F.col("_typed") & ((n < 8) | (field(6) != "-----")), "record_dialect_invalid"),
        F.when(classic & (F.char_length(field(5)) != 5), "record_dialect_invalid"),
        F.when(~F.col("_roleset").contains("."), "roleset_invalid"),
        first_label_error,
        F.when(classic & F.exists(labels, lambda x: x["raw"].contains(";")), "classic_pointer_operator_unsupported"),
        F.when(classic & F.exists(labels, lambda x: x["label"].rlike("^(?:LINK-|C-|R-)")), "classic_label_unsupported"),
        F.when(F.size(F.filter(labels, lambda x: x["label"] == "rel")) != 1, "predicate_label_count_invalid"),
    )
    return rows.select(
        *df.columns,
        "raw_line",
        field(0).alias("document_id"),
        index(1).alias("sentence_index"),
        index(2).alias("predicate_terminal"),
        field(3).alias("annotator"),
        F.col("_roleset").alias("roleset"),
        F.when(F.col("_typed"), "modern").otherwise("classic").alias("dialect"),
        F.when(F.col("_typed"), F.regexp_extract(field(4), TYPED_LEMMA, 1)).alias("lemma"),
        F.when(F.col("_typed"), F.regexp_extract(field(4), TYPED_LEMMA, 2)).alias("kind"),
        F.when(classic, field(5)).alias("inflection"),
        F.transform("_labels", lambda x: F.struct(x["label"].alias("label"), x["raw"].alias("raw"), x["members"].alias("members"))).alias("labels"),
        error.alias("record_error"),
    )


def resolve_nodes(pointer_nodes: Column, nodes: Column, terminals: Column) -> Column:
    """``array<struct<error, label, lt, nt, surface array<int>>>`` of pointer nodes in a tree.

    Each transform binds what the next one uses several times, so nothing is computed twice.
    """
    inside = F.transform(pointer_nodes, lambda n: F.struct(n.alias("n"), F.when(n["t"] < F.size(terminals), F.try_element_at(terminals, n["t"] + 1)).alias("x")))
    level = F.transform(inside, lambda p: F.struct(p["n"]["t"].alias("t"), (p["x"]["level"] - p["n"]["h"]).alias("level"), (p["x"]["node"] - p["n"]["h"]).alias("node")))
    above = F.transform(level, lambda n: F.struct(n.alias("n"), F.when(n["level"] >= 0, F.try_element_at(nodes, n["node"] + 1)).alias("x")))
    target = F.transform(
        above, lambda p: F.struct(p["n"]["level"].alias("level"), F.when((p["x"]["lt"] == p["n"]["t"]) & (p["x"]["level"] == p["n"]["level"]), p["x"]).alias("x"))
    )

    def result(n: Column) -> Column:
        error = (
            F.when(n["level"].isNull(), "pointer_terminal_out_of_range")
            .when(n["level"] < 0, "pointer_height_out_of_range")
            .when(n["x"].isNull(), "pointer_leftmost_terminal_mismatch")
        )
        covered = F.transform(F.slice(terminals, n["x"]["lt"] + 1, n["x"]["nt"]), lambda t: t["surface"])
        surface = F.when(n["x"].isNotNull(), F.filter(covered, lambda s: s.isNotNull()))
        return F.struct(error.alias("error"), n["x"]["label"].alias("label"), n["x"]["lt"].alias("lt"), n["x"]["nt"].alias("nt"), surface.alias("surface"))

    return F.transform(target, result)


def resolve_pointers(df: DataFrame, members_col: str = "members", *keys: str) -> DataFrame:
    """One row per pointer node of rows with ``members``, ``nodes`` and ``terminals``."""
    flat = F.flatten(F.transform(members_col, lambda m, i: F.transform(m["nodes"], lambda n, j: F.struct(i.alias("member"), j.alias("piece"), n.alias("n")))))
    rows = df.select(*keys, "nodes", "terminals", F.explode(flat).alias("x"))
    rows = computed_once(rows, "r", F.element_at(resolve_nodes(F.array("x.n"), F.col("nodes"), F.col("terminals")), 1))
    return rows.select(*keys, "x.member", "x.piece", "x.n.t", "x.n.h", F.col("r.error").alias("pointer_error"), F.col("r.label").alias("node_label"), "r.lt", "r.nt", F.col("r.surface").alias("surface"))


def resolved_label(label: Column, nodes: Column, terminals: Column) -> Column:
    """A label with its resolved members: ``struct<label, raw, members, resolved array<array<struct>>>``."""
    resolved = F.transform(label["members"], lambda m: resolve_nodes(m["nodes"], nodes, terminals))
    return F.struct(label["label"].alias("label"), label["raw"].alias("raw"), label["members"].alias("members"), resolved.alias("resolved"))


def pointer_code(label: Column) -> Column:
    """The first pointer error of a resolved label."""
    errors = F.filter(F.transform(F.flatten(label["resolved"]), lambda r: r["error"]), lambda e: e.isNotNull())
    return F.try_element_at(errors, F.lit(1))


def with_pieces(label: Column) -> Column:
    """``struct<label, raw, code, bearing, pieces>``: the surface pieces of the one member that has words, and
    the number of such members."""
    surface = lambda m: F.filter(F.transform(m, lambda r: r["surface"]), lambda s: F.size(s) > 0)
    bearing = F.filter(F.transform(label["resolved"], surface), lambda pieces: F.size(pieces) > 0)

    def summary(pieces: Column) -> Column:
        return F.struct(
            label["label"].alias("label"),
            label["raw"].alias("raw"),
            label["members"].alias("members"),
            pointer_code(label).alias("code"),
            F.size(pieces).alias("bearing"),
            F.coalesce(F.try_element_at(pieces, F.lit(1)), F.array().cast("array<array<int>>")).alias("pieces"),
        )

    return F.element_at(F.transform(F.array(bearing), summary), 1)


def pieces_code(x: Column, none: str, several: str) -> Column:
    """The code of resolved pieces: no words, more than one member with words, or overlapping pieces."""
    distinct = F.array_distinct(x["pieces"])
    overlap = F.size(F.flatten(distinct)) != F.size(F.array_distinct(F.flatten(distinct)))
    return F.coalesce(x["code"], F.when(x["bearing"] == 0, none).when(x["bearing"] > 1, several).when(overlap, "pointer_piece_overlap"))


def first_code(codes: Column) -> Column:
    return F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1))


def deny_wsj(document_id: Column) -> Column:
    """The usual source policy: documents whose base name starts with ``wsj_`` are denied."""
    name = F.element_at(F.split(F.rtrim(F.regexp_replace(document_id, r"\\", "/"), F.lit("/")), "/"), -1)
    return F.when(F.lower(name).startswith("wsj_"), "excluded_source_wsj")


def allow_all(document_id: Column) -> Column:
    """No document is denied."""
    return F.lit(None).cast("string")


def conversion_rows(
    records: DataFrame, trees: DataFrame, policy: Callable[[Column], Column] = deny_wsj, allowed_tags: Sequence[str] = VERBAL_TAGS
) -> DataFrame:
    """Records with ``reason_code`` (null if converted) and, if converted, ``words, predicate_index, tags`` and
    provenance. ``trees`` is ``(document_id, sentence_index, nodes, terminals, tree_error)``, one row per sentence."""
    keep = ["raw_line", "document_id", "sentence_index", "predicate_terminal", "annotator", "roleset", "dialect", "kind", "labels", "record_error"]
    key = ["document_id", "sentence_index"]
    rows = records.select(*keep).join(trees.select(*key, "nodes", "terminals", "tree_error", F.lit(True).alias("_found")), key, "left")
    nodes, terminals = F.col("nodes"), F.col("terminals")
    usable = F.col("record_error").isNull() & F.col("tree_error").isNull() & F.col("_found").isNotNull()

    labels = F.transform(F.transform("labels", lambda x: resolved_label(x, nodes, terminals)), with_pieces)
    rows = computed_once(rows, "x", F.when(usable, labels))
    rel = F.try_element_at(F.filter("x", lambda v: v["label"] == "rel"), F.lit(1))
    is_argument = lambda v: (v["label"] != "rel") & ~v["label"].startswith("LINK-")
    arguments = F.transform(F.filter("x", is_argument), lambda v: v.withField("model", model_label(v["label"])).withField("role_error", role_error(v["label"])))
    terminal = F.try_element_at(terminals, F.col("predicate_terminal") + 1)
    parts = F.struct(
        rel.alias("rel"), arguments.alias("args"), F.filter("x", lambda v: v["label"].startswith("LINK-")).alias("links"), terminal.alias("terminal"),
        (F.col("predicate_terminal") < F.size(terminals)).alias("inside"), surface_words(terminals).alias("words"),
    )
    rows = computed_once(rows, "p", F.when(usable, parts))
    args, links, rel = F.col("p.args"), F.col("p.links"), F.col("p.rel")
    models = F.transform(args, lambda a: a["model"])
    surface = F.col("p.terminal.surface")

    def link_code(link: Column) -> Column:
        all_nodes = lambda v: F.flatten(F.transform(v["members"], lambda m: m["nodes"]))
        sharing = F.size(F.filter(args, lambda a: F.size(F.array_intersect(all_nodes(a), all_nodes(link))) > 0))
        return (
            F.when(~link["label"].isin(*LINK_LABELS), "unsupported_link_type")
            .when(F.size(link["members"]) < 2, "link_chain_invalid")
            .when(sharing == 0, "link_argument_missing")
            .when(sharing > 1, "link_argument_ambiguous")
            .otherwise(link["code"])
        )

    def base_code(model: Column) -> Column:
        missing = model.rlike("^[CR]-") & ~F.array_contains(models, F.substring(model, F.lit(3), F.char_length(model)))
        return F.when(missing & model.startswith("C-"), "continuation_role_without_base").when(missing, "reference_role_without_base")

    def order_code(a: Column) -> Column:
        base = F.flatten(F.flatten(F.transform(F.filter(args, lambda b: F.concat(F.lit("C-"), b["model"]) == a["model"]), lambda b: b["pieces"])))
        return F.when(a["model"].startswith("C-") & (F.array_min(F.flatten(a["pieces"])) <= F.array_max(base)), "continuation_role_precedes_base")

    covered = F.flatten(F.transform(args, lambda a: F.flatten(F.array_distinct(a["pieces"]))))
    extra = F.filter(F.flatten(rel["pieces"]), lambda i: i != surface)
    codes = F.array(
        F.coalesce("tree_error", "record_error", F.when(F.col("_found").isNull(), F.lit("sentence_index_out_of_range"))),
        policy(F.col("document_id")),
        F.when(~F.col("p.inside"), "predicate_terminal_out_of_range"),
        F.when(surface.isNull(), "predicate_has_no_surface"),
        F.when((F.col("dialect") == "modern") & (F.col("kind") != "v"), "nonverbal_type"),
        F.when(~F.col("p.terminal.pos").isin(*allowed_tags), "predicate_pos_mismatch"),
        pieces_code(rel, "predicate_has_no_surface", "predicate_chain_ambiguous"),
        F.when(~F.array_contains(F.flatten(rel["pieces"]), surface), "rel_does_not_cover_predicate"),
        first_code(F.transform(links, link_code)),
        first_code(F.transform(args, lambda a: a["role_error"])),
        first_code(F.transform(models, base_code)),
        first_code(F.transform(args, lambda a: pieces_code(a, "argument_has_no_surface_realization", "argument_trace_chain_ambiguous"))),
        first_code(F.transform(args, order_code)),
        F.when(F.size(covered) != F.size(F.array_distinct(covered)), "semantic_role_overlap"),
        F.when(F.array_contains(covered, surface), "predicate_argument_overlap"),
        F.when((F.size(F.array_distinct(extra)) != F.size(extra)) | (F.size(F.array_intersect(extra, covered)) > 0), "predicate_piece_overlap"),
    )
    rows = computed_once(rows, "codes", codes)
    rows = rows.withColumn("reason_code", first_code(F.col("codes"))).drop("codes")

    # one entry per labelled word: the word, its label, and whether it continues a run of its piece
    def entries(pieces: Column, label: Column) -> Column:
        each = lambda piece: F.transform(piece, lambda i: F.struct(i.alias("i"), F.concat(F.when(F.array_contains(piece, i - 1), "I-").otherwise("B-"), label).alias("tag")))
        return F.flatten(F.transform(pieces, each))

    of_args = F.flatten(F.transform(args, lambda a: entries(F.array_distinct(a["pieces"]), a["model"])))
    of_rel = entries(F.transform(rel["pieces"], lambda piece: F.filter(piece, lambda i: i != surface)), F.lit("C-V"))
    written = F.concat(of_args, F.array(F.struct(surface.alias("i"), F.lit("B-V").alias("tag"))), of_rel)
    good = F.col("reason_code").isNull()
    rows = computed_once(rows, "tag_at", F.when(good, F.map_from_entries(written)))
    tags = F.transform("p.words", lambda _, i: F.coalesce(F.try_element_at("tag_at", i), F.lit("O")))
    repeated = F.flatten(
        F.transform(args, lambda a, i: F.transform(F.slice(a["pieces"], F.lit(1), F.size(a["pieces"]) - F.size(F.array_distinct(a["pieces"]))), lambda _: F.concat(F.lit("duplicate_pointer_deduplicated:"), i.cast("string"))))
    )
    record_id = F.concat_ws(":", "document_id", F.col("sentence_index").cast("string"), F.col("predicate_terminal").cast("string"))
    return rows.select(
        record_id.alias("record_id"), "raw_line", "document_id", "sentence_index", "predicate_terminal", "roleset", "dialect", "reason_code",
        F.when(good, F.col("p.words")).alias("words"),
        F.when(good, surface).alias("predicate_index"),
        F.when(good, tags).alias("tags"),
        F.when(good, F.col("p.terminal.pos")).alias("predicate_pos"),
        F.when(good, F.transform(terminals, lambda t: t["surface"])).alias("terminal_to_word"),
        F.when(good, F.array_sort(F.array_distinct(F.flatten(rel["pieces"])))).alias("predicate_words"),
        F.when(good, F.transform(args, lambda a: F.struct(
            a["label"].alias("raw_label"), a["model"].alias("model_label"), role_feature(a["label"]).alias("feature"), a["raw"].alias("raw_pointer"),
            F.array_distinct(a["pieces"]).alias("pieces")))).alias("roles"),
        F.when(good, F.transform(links, lambda v: v["label"])).alias("link_labels"),
        F.when(good, repeated).alias("warnings"),
    )


def examples_of(converted: DataFrame) -> DataFrame:
    """The model-facing examples of converted records."""
    return converted.where("reason_code is null").select(
        F.col("record_id").alias("example_id"), "document_id",
        F.concat_ws(":", "document_id", F.col("sentence_index").cast("string")).alias("sentence_id"),
        "words", "predicate_index", "tags", F.col("roleset").alias("predicate_roleset"),
    )


def provenance_of(converted: DataFrame) -> DataFrame:
    """What the conversion did, kept apart from the examples and joined by ``record_id``."""
    return converted.where("reason_code is null").select(
        "record_id", "raw_line", "document_id", "dialect", "predicate_terminal", "predicate_pos", "terminal_to_word", "predicate_words", "roles", "link_labels", "warnings"
    )


def rejects_of(converted: DataFrame) -> DataFrame:
    return converted.where("reason_code is not null").select("record_id", "raw_line", "reason_code")


def coverage(converted: DataFrame) -> DataFrame:
    """Counts per reason (null: converted) with their share of all records."""
    counts = converted.groupBy("reason_code").agg(F.count("*").alias("records"))
    return counts.select("reason_code", "records", (F.col("records") / F.sum("records").over(_whole())).alias("share"))


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # a few rows, one per reason
