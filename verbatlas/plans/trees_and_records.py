"""Queries of trees, pointers, proposition records, their conversion and label alignment, and their SQL twins.

Trees come from two places: regions, nations and customers as a three-level tree, and the tree leaves of
``penn_terminals`` put back into brackets by their paths. Records are written from the role spans of
``srl_examples``, one pointer node per word, and, as cases of every rule, from ``CASES``: one record for each sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.operators import align, bio, propositions, trees
from verbatlas.plans import conversion_sql
from verbatlas.session import materialize, read


def geo_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(region, source)``: one bracketed tree per region."""
    leaf = F.format_string("(C %s)", F.regexp_replace("c_name", r"\s", "_"))
    customers = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(leaf)), " ").alias("leaves"))
    nations = read(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    branch = F.format_string("(N%s %s)", F.col("n_nationkey").cast("string"), F.coalesce("leaves", F.lit("(-NONE- *)")))
    regions = nations.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", branch.alias("b"))))["b"], " ").alias("b"))
    return regions.select(F.col("n_regionkey").alias("region"), F.format_string("( (TOP %s) )", "b").alias("source"))


def common_levels(a: Column, b: Column) -> Column:
    """How many numbers two paths have in common from their beginning."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def bracket_text(leaves: Column) -> Column:
    """The brackets of a tree from its leaves ``array<struct<t, path, pos, word>>`` in order; inner nodes are X."""

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(leaves, F.greatest(i, F.lit(1)))["path"])
        shared = F.when(i > 0, common_levels(before, x["path"]) + 1).otherwise(0)
        closes = F.when(i > 0, F.repeat(F.lit(")"), F.size(before) - shared)).otherwise("")
        return F.concat(closes, F.repeat(F.lit("(X "), F.size(x["path"]) - shared), F.lit("("), written(x["pos"]), F.lit(" "), written(x["word"]), F.lit(")"))

    last = F.element_at(leaves, F.lit(-1))
    return F.concat(F.array_join(F.transform(leaves, piece), ""), F.repeat(F.lit(")"), F.size(last["path"])))


WHITE = r"[\p{Z}\t\n\x0B\f\r\x1c-\x1f\x85]"


def written(text: Column) -> Column:
    """A text as one token of brackets and records: -LRB- and -RRB- for brackets, _ for white space, -NULL- and -EMPTY- for none."""
    token = F.regexp_replace(F.replace(F.replace(text, F.lit("("), F.lit("-LRB-")), F.lit(")"), F.lit("-RRB-")), WHITE, "_")
    return F.when(text.isNull(), "-NULL-").when(text == "", "-EMPTY-").otherwise(token)


def sentence_trees(terminals: DataFrame) -> DataFrame:
    """``(document_id, sentence_index, whole, source)`` of all sentences; ``source`` is null unless the leaves are numbered from 0 without gap or repetition."""
    leaf = F.struct(F.col("terminal_index").alias("t"), F.col("preterminal_path").alias("path"), "pos", "word")
    grouped = terminals.groupBy("document_id", "sentence_index").agg(F.array_sort(F.collect_set(leaf)).alias("leaves"))
    numbered = F.forall(F.transform("leaves", lambda x, i: x["t"].eqNullSafe(i) & x["path"].isNotNull()), lambda good: good)
    return grouped.withColumn("whole", numbered).select("document_id", "sentence_index", "whole", F.when(F.col("whole"), bracket_text(F.col("leaves"))).alias("source"))


def parsed_terminals(terminals: DataFrame) -> DataFrame:
    """The trees of all sentences, one row each; leaves that are not whole have the tree_error ``tree_terminals_incomplete``."""
    found = trees.parse_trees(sentence_trees(terminals), "source", "document_id", "sentence_index", "whole", single=True)
    return found.withColumn("tree_error", F.when(F.col("whole"), F.col("tree_error")).otherwise("tree_terminals_incomplete")).drop("whole")


def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_terminals(read(spark, sf_dir, "penn_terminals"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.nodes_long(trees.parse_trees(geo_trees(spark, sf_dir), "source", "region", single=True), "region").drop("tree_no", "node")


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.terminals_long(parsed_sentences(spark, sf_dir), "document_id", "sentence_index")
    return found.drop("tree_no").withColumn("surface", F.coalesce("surface", F.lit(-1)))


def preterminal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.preterminal_paths(parsed_sentences(spark, sf_dir), "document_id", "sentence_index")
    return found.select("document_id", "sentence_index", "t", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


def surface_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_sentences(spark, sf_dir).select("document_id", "sentence_index", F.array_join(trees.surface_words(F.col("terminals")), " ").alias("words"))


def balanced_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.balanced_counts(geo_trees(spark, sf_dir), "source", "region")
    return found.select("region", "sentences", F.element_at("terminals", 1).alias("n_terminals"))


#: Ends of pointer texts, well formed and not.
POINTER_ENDS = ("", ",3:1*4:0", ";5:2", ";1:0*2:2", "-", "*2:1", ";1:0,2:0", "*", ",1", "*1:0*2:0,3:0", " ", ":", "*x:0")


def pointer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer texts made from events, well formed and not, taken apart."""
    end = F.element_at(F.array(*map(F.lit, POINTER_ENDS)), (F.col("event_id") % len(POINTER_ENDS)).cast("int") + 1)
    raw = F.when(F.col("event_id") % 97 != 0, F.concat((F.col("user_id") % 50).cast("string"), F.lit(":"), (F.col("event_id") % 4).cast("string"), end)).otherwise("")
    found = propositions.parse_pointers(read(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw")
    node = lambda n: F.concat_ws(":", n["t"].cast("string"), n["h"].cast("string"))
    member = lambda m: F.call_function("array_join", F.transform(m["nodes"], node), F.coalesce(m["operator"], F.lit("")))
    return found.select("event_id", "raw", "pointer_error", F.array_join(F.transform("members", member), "*").alias("members"), F.coalesce(F.size("members"), F.lit(0)).alias("n_members"))


def pointer_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every terminal of the sentence trees with the heights 0 to 3."""
    rows = parsed_sentences(spark, sf_dir).where("tree_error is null")
    heights = F.flatten(F.transform(F.sequence(F.lit(0), F.size("terminals") - 1), lambda t: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda h: F.struct(t.cast("int").alias("t"), h.cast("int").alias("h")))))
    member = F.array(F.struct(heights.alias("nodes"), F.lit(",").alias("operator")))
    found = propositions.resolve_pointers(rows.withColumn("members", member), "members", "document_id", "sentence_index")
    return found.select("document_id", "sentence_index", "t", "h", "pointer_error", F.coalesce("nt", F.lit(-1)).alias("nt"), F.coalesce(F.size("surface"), F.lit(-1)).alias("n_surface"))


def record_lines(examples: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(example_id, example_error, line)``: a record of every example.

    Pointers are the terminals of the words in the tree, or the numbers of the words where no tree can tell. What a line
    cannot say is ``example_error``: ``example_tags_invalid``, ``example_word_count_mismatch`` (with the tree).
    """
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    rows = examples.select("example_id", "document_id", size("words").alias("n_words"), "predicate_index", "tags", "predicate_roleset").dropDuplicates(["example_id"])
    rows = rows.withColumn("sentence_index", F.try_element_at(F.split("example_id", ":"), F.lit(-2)).try_cast("int")).withColumn("n_tags", size("tags"))
    invalid = F.col("error").isNotNull() | (F.col("n_tags") == 0) | (F.col("n_tags") != F.col("n_words"))
    rows = bio.decoded(rows).withColumn("invalid", invalid).drop("tags", "repaired", "error")
    in_tree = F.transform(F.filter(F.transform("terminals", lambda t, i: F.struct(t["surface"].alias("s"), i.alias("i"))), lambda x: x["s"].isNotNull()), lambda x: x["i"])
    sentences = parsed.select("document_id", "sentence_index", F.when(F.col("tree_error").isNull(), in_tree).alias("in_tree"))
    joined = rows.join(sentences, ["document_id", "sentence_index"], "left")
    mismatch = F.col("in_tree").isNotNull() & (size("in_tree") != F.col("n_words"))
    by_number = F.transform(F.array_repeat(F.lit(0), F.col("n_tags")), lambda _, i: i)
    joined = joined.withColumn("example_error", F.when(F.col("invalid"), "example_tags_invalid").when(mismatch, "example_word_count_mismatch"))
    joined = joined.withColumn("at", F.when(F.col("in_tree").isNotNull() & F.col("example_error").isNull(), F.col("in_tree")).otherwise(by_number))
    node = lambda w: F.concat(F.element_at("at", w + 1).cast("string"), F.lit(":0"))
    pointer = lambda s: F.array_join(F.transform(F.sequence(s["start"], s["end"] - 1), node), ",")
    label = lambda s: F.concat(pointer(s), F.lit("-"), F.when(s["label"] == "V", "rel").otherwise(s["label"]))
    lemma = F.substring_index(written(F.col("predicate_roleset")), ".", 1)
    predicate = F.when(F.col("predicate_index") >= 0, F.try_element_at("at", F.col("predicate_index") + 1))
    head = F.concat_ws(
        " ", written(F.col("document_id")), written(F.col("sentence_index").cast("string")), written(predicate.cast("string")), F.lit("gold"),
        F.concat(lemma, F.lit("-v")), written(F.col("predicate_roleset")), F.lit("-----"),
    )
    return joined.select("example_id", "example_error", F.concat_ws(" ", head, F.array_join(F.transform("spans", label), " ")).alias("line"))


def example_records(examples: DataFrame, parsed: DataFrame) -> DataFrame:
    """The parsed records of all examples; ``example_error`` comes before what the line shows."""
    found = propositions.parse_records(record_lines(examples, parsed))
    return found.withColumn("record_error", F.coalesce("example_error", "record_error"))


def parsed_once(parsed: DataFrame) -> DataFrame:
    """Trees for conversion, written once: records and their conversion both read them."""
    return materialize(parsed.withColumn("terminals", F.transform("terminals", lambda t: t.dropFields("path"))), "trees")


def conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_once(parsed_sentences(spark, sf_dir))
    return propositions.conversion_rows(example_records(read(spark, sf_dir, "srl_examples"), parsed), parsed)


TYPED = "{d} {s} {v} gold go-v go.01 ----- "

#: Records of every kind. Of a sentence: d document, s number, v first verb, e first empty element (else the last one), n last terminal,
#: o a terminal outside.
CASES = (
    *(TYPED + labels for labels in (
        "{v}:0-rel 0:0-ARG0", "{v}:0-rel 0:1-ARG0", "{v}:0-rel 0:2-ARG1-xy", "{v}:0-rel 0:0*{n}:0-ARG1", "{v}:0-rel {e}:0-ARG1", "{v}:0-rel {e}:0*0:0-ARG1", "{v}:0-rel 0:9-ARG0",
        "{v}:0-rel {o}:0-ARG0", "{v}:0-rel 0:0,0:0-ARG0 {n}:0-ARGM-TMP", "{v}:0-rel 0:0-ARGM", "{v}:0-rel 0:0-FOO", "{v}:0-rel 0:0-C-ARG1", "{v}:0-rel 0:0-R-ARG1",
        "{v}:0-rel {n}:0-ARG1 0:0-C-ARG1", "{v}:0-rel 0:0-ARG0 0:0-ARG1", "{v}:0-rel {v}:0-ARG0", "{v}:1-rel 0:0-ARG0", "{v}:0*0:0-rel", "0:0-rel", "{v}:0-rel 0:0*{e}:0-LINK-XYZ",
        "{v}:0-rel 0:0-LINK-PCR", "{v}:0-rel {e}:0*0:0-LINK-PCR", "{v}:0-rel 0:0-ARG0 {n}:0-ARG1 0:0*{n}:0-LINK-PCR", "{v}:0-rel 0:0-ARG0 {e}:0*0:0-LINK-PCR {e}:0*0:0-LINK-SLC",
        "{v}:0-rel 0:0;{n}:0-ARG0", "{v}:0-rel 0:0;1:0*2:0-ARG0", "{v}:0-rel 0:0;1:0,2:0-ARG0", "{v}:0-rel bad", "0:0-ARG0", "{v}:0-rel {v}:0-rel", "{v}:0,0:0-rel 0:0-ARG0",
        "{v}:0-rel 0:1,0:0-ARG0", "{v}:0-rel 1:2-ARG0", "{v}:0,{n}:0-rel 0:0-ARG0 0:0-LINK", "{v}:0-rel 0:3-ARG2 {e}:1-ARG1",
    )),
    "{d} {s} {v} gold go-n go.01 ----- {v}:0-rel", "{d} {s} {v} gold go.01 vp--a {v}:0-rel 0:0-ARG0", "{d} {s} {v} gold go.01 vp--a {v}:0-rel 0:0;1:0-ARG0", "{d} {s} {v} gold go.01 vp--a {v}:0-rel 0:0-C-ARG0",
    "{d} {s} {v} gold go.01 vp-a {v}:0-rel 0:0-ARG0", "{d} {s} {v} gold go-v go.01 --- {v}:0-rel", "{d} {s} {v} gold go-v go ----- {v}:0-rel", "{d} x {v} gold go-v go.01 ----- {v}:0-rel",
    "{d} {s} {v} gold go-v", "  ", "{d} 9999 {v} gold go-v go.01 ----- {v}:0-rel", "{d} {s} {o} gold go-v go.01 ----- {v}:0-rel", "{d} {s} {e} gold go-v go.01 ----- {v}:0-rel 0:0-ARG0",
    "wsj_{d} {s} {v} gold go-v go.01 ----- {v}:0-rel",
)


def case_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of ``CASES`` for each sentence, converted; the sentences of the last case are renamed in the trees too."""
    parsed = parsed_once(parsed_sentences(spark, sf_dir))
    place = lambda test: F.coalesce(F.array_position(F.transform("terminals", test), F.lit(True)), F.lit(0)) - 1
    n = F.coalesce(F.array_size("terminals"), F.lit(0))
    rows = parsed.select("document_id", "sentence_index", "nodes", "terminals", "tree_error", n.alias("n"), place(lambda t: t["pos"].startswith("VB")).alias("v"), place(lambda t: t["surface"].isNull()).alias("e"))
    rows = rows.withColumn("case", F.pmod(F.col("n") * 31 + F.coalesce("sentence_index", F.lit(0)) * 17 + F.col("v") * 5, F.lit(len(CASES))).cast("int"))
    line = F.element_at(F.array(*map(F.lit, CASES)), F.col("case") + 1)
    values = {
        "{d}": F.coalesce("document_id", F.lit("")), "{s}": F.coalesce(F.col("sentence_index").cast("string"), F.lit("")), "{v}": F.greatest("v", F.lit(0)).cast("string"),
        "{e}": F.when(F.col("e") >= 0, F.col("e")).otherwise(F.greatest(F.col("n") - 1, F.lit(0))).cast("string"), "{n}": F.greatest(F.col("n") - 1, F.lit(0)).cast("string"), "{o}": (F.col("n") + 3).cast("string"),
    }
    for name, value in values.items():
        line = F.replace(line, F.lit(name), value)
    renamed = F.when(F.col("case") == len(CASES) - 1, F.concat(F.lit("wsj_"), "document_id")).otherwise(F.col("document_id"))
    rows = materialize(rows.withColumn("line", line).withColumn("document_id", renamed), "case-trees")
    return propositions.conversion_rows(propositions.parse_records(rows.select("line")), rows)


def record_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason of every case record."""
    return case_conversions(spark, sf_dir).select("raw_line", "record_id", "reason_code")


def record_case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions.coverage(case_conversions(spark, sf_dir)).withColumn("share", F.round("share", 6))


def record_case_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = propositions.examples_of(case_conversions(spark, sf_dir))
    return found.select("example_id", F.posexplode("tags").alias("pos", "tag"))


def provenance_text(converted: DataFrame) -> DataFrame:
    """Provenance with its arrays written out."""
    numbers = lambda a, sep: F.array_join(F.transform(a, lambda x: x.cast("string")), sep, "-")
    role = lambda r: F.concat_ws("|", r["raw_label"], r["model_label"], F.coalesce(r["feature"], F.lit("")), r["raw_pointer"], F.array_join(F.transform(r["pieces"], lambda p: numbers(p, ",")), ";"))
    return propositions.provenance_of(converted).select(
        "record_id", "raw_line", "document_id", "dialect", "predicate_terminal", "predicate_pos", numbers("terminal_to_word", " ").alias("terminal_to_word"), numbers("predicate_words", " ").alias("predicate_words"),
        F.array_join(F.transform("roles", role), " ").alias("roles"), F.array_join("link_labels", " ").alias("link_labels"), F.array_join("warnings", " ").alias("warnings"),
    )


def record_case_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance_text(case_conversions(spark, sf_dir))


def prop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = example_records(read(spark, sf_dir, "srl_examples"), parsed_sentences(spark, sf_dir))
    label = lambda x: F.concat_ws("|", x["label"], x["raw"])
    return found.select("example_id", "document_id", "sentence_index", "roleset", "dialect", "kind", F.size("labels").alias("n_labels"), F.array_join(F.transform("labels", label), " ").alias("labels"), "record_error")


def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct role labels of all tags, normalised."""
    labels = read(spark, sf_dir, "srl_examples").select(F.explode("tags").alias("t")).select(bio.label_of(F.col("t")).alias("raw_label")).distinct().where("raw_label <> ''")
    raw = F.col("raw_label")
    return labels.select("raw_label", propositions.model_label(raw).alias("model_label"), propositions.role_feature(raw).alias("feature"), propositions.role_error(raw).alias("reason_code"))


def conversion_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversions(spark, sf_dir).select("record_id", "document_id", "reason_code")


def bio_from_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written tags of the converted records; every pointer node is a piece of its own."""
    found = propositions.examples_of(conversions(spark, sf_dir))
    return found.select("example_id", F.posexplode("tags").alias("pos", "tag"))


def conversion_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance_text(conversions(spark, sf_dir))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propositions.coverage(conversions(spark, sf_dir)).withColumn("share", F.round("share", 6))


def role_base_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuation and reference roles of examples that have no base role."""
    rows = read(spark, sf_dir, "srl_examples").select("example_id", F.explode(F.array_distinct(F.transform("tags", bio.label_of))).alias("label")).distinct()
    marked = rows.where(F.col("label").rlike("^[CR]-")).withColumn("base", F.substring("label", F.lit(3), F.char_length("label")))
    return marked.join(rows.select("example_id", F.col("label").alias("base")), ["example_id", "base"], "left_anti").select("example_id", "label")


def fixed_pieces(batch):
    """A tokenizer for tests and queries: pieces of at most four letters, one special position at each end."""
    found = []
    for words in batch:
        ids, numbers = [101], [None]
        for n, word in enumerate(words):
            for k in range(0, max(1, len(word or "")), 4):
                ids.append(1000 + sum(map(ord, (word or "")[k : k + 4])) % 997)
                numbers.append(n)
        found.append(([*ids, 102], [*numbers, None]))
    return found


#: Labels of the alignment queries with their ids.
LABEL_IDS = {"O": 0} | {f"{p}-{r}": i for i, (r, p) in enumerate(((r, p) for r in ("ARG0", "ARG1", "ARG2", "V", "ARGM-TMP", "ARGM-LOC") for p in "BI"), 1)}


def subword_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "srl_examples").select("example_id", "words", "tags", "predicate_index").dropDuplicates(["example_id"])
    found = align.align_labels(align.tokenize_words(rows, fixed_pieces), LABEL_IDS)
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return found.select("example_id", "align_error", F.size("input_ids").alias("n_pieces"), numbers("labels").alias("labels"), numbers("token_type_ids").alias("indicator"))


def faulty_pieces(batch):
    """One piece a word, but for sentences of some lengths with a fault: the last word left out, the first two in
    turned order, a word that is not there, an id too few."""
    found = []
    for words in batch:
        numbers, fault = list(range(len(words))), len(words) % 6
        if fault == 1:
            numbers = numbers[:-1]
        elif fault == 2:
            numbers[:2] = numbers[1::-1]
        elif fault == 3:
            numbers[-1] = len(words)
        found.append(([7] * (len(numbers) - (fault == 4)), numbers))
    return found


def alignment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "srl_examples").select("example_id", "words", "tags", "predicate_index").dropDuplicates(["example_id"])
    return align.align_labels(align.tokenize_words(rows, faulty_pieces), LABEL_IDS).select("example_id", "align_error", F.coalesce(F.size("labels"), F.lit(-1)).alias("n_labels"))


def queries() -> dict:
    return {f.__name__: f for f in (
        alignment_errors, tree_nodes, terminals, preterminal_paths, surface_words, balanced_tree_counts, pointer_parse, pointer_resolution, prop_records, role_labels,
        conversion_outcomes, bio_from_pointers, conversion_provenance, coverage_report, role_base_anti, subword_alignment,
        record_cases, record_case_coverage, record_case_tags, record_case_provenance,
    )}


LEAVES = conversion_sql.LEAVES
RECORDS = LEAVES + conversion_sql.EXAMPLE_LINES + conversion_sql.RECORDS
OUTCOMES = RECORDS + conversion_sql.OUTCOMES

CASE_OUTCOMES = LEAVES.replace("raw_leaf AS", "raw_leaf0 AS", 1).replace("FROM penn_terminals)", f"""FROM penn_terminals),
place AS (SELECT document_id, sentence_index, CASE WHEN count(*) = count(DISTINCT terminal_index) AND count(*) = count(terminal_index) AND count(*) = count(preterminal_path) AND min(terminal_index) = 0 AND max(terminal_index) = count(*) - 1 THEN count(*) ELSE 0 END AS n,
    coalesce(min(terminal_index) FILTER (WHERE starts_with(pos, 'VB')), -1) AS v, coalesce(min(terminal_index) FILTER (WHERE pos = '-NONE-'), -1) AS e FROM raw_leaf0 GROUP BY ALL),
place2 AS (SELECT document_id, sentence_index, n, if(n = 0, -1, v) AS v, if(n = 0, -1, e) AS e FROM place),
choice AS (SELECT *, ((n * 31 + sentence_index * 17 + v * 5) % {len(CASES)} + {len(CASES)}) % {len(CASES)} AS number FROM place2),
raw_leaf AS (SELECT if(number = {len(CASES) - 1}, 'wsj_', '') || document_id AS document_id, sentence_index, terminal_index, word, pos, preterminal_path FROM raw_leaf0 JOIN choice USING (document_id, sentence_index))""", 1) + f""",
line AS (SELECT document_id || ':' || sentence_index AS rid, NULL::VARCHAR AS example_error, replace(replace(replace(replace(replace(replace([{", ".join(f"'{c}'" for c in CASES)}][number + 1],
  '{{d}}', document_id), '{{s}}', sentence_index::VARCHAR), '{{v}}', greatest(v, 0)::VARCHAR), '{{e}}', if(e >= 0, e, greatest(n - 1, 0))::VARCHAR), '{{n}}', greatest(n - 1, 0)::VARCHAR), '{{o}}', (n + 3)::VARCHAR) AS raw FROM choice)""" + conversion_sql.RECORDS + conversion_sql.OUTCOMES

GEO = """
WITH c AS (SELECT c_nationkey AS nation, replace(c_name, ' ', '_') AS name FROM customer),
leaf AS (SELECT n_regionkey AS region, n_nationkey AS nation, 'C' AS pos, name FROM nation JOIN c ON nation = n_nationkey
  UNION ALL SELECT n_regionkey, n_nationkey, '-NONE-', '*' FROM nation WHERE n_nationkey NOT IN (SELECT nation FROM c)),
t AS (SELECT *, (row_number() OVER (PARTITION BY region ORDER BY nation, '(C ' || name || ')') - 1)::INT AS t FROM leaf)"""


def oracle_sql() -> dict[str, str]:
    return {
        "tree_nodes": f"""{GEO}
SELECT region, 0 AS level, 'TOP' AS label, 0 AS lt, count(*)::INT AS nt FROM t GROUP BY region
UNION ALL SELECT region, 1, 'N' || nation, min(t), count(*)::INT FROM t GROUP BY region, nation
UNION ALL SELECT region, 2, pos, t, 1 FROM t""",
        "balanced_tree_counts": f"{GEO} SELECT region, 1 AS sentences, count(*)::INT AS n_terminals FROM t GROUP BY region",
        "terminals": f"{LEAVES} SELECT document_id, sentence_index, terminal_index AS t, word, pos, len(preterminal_path)::INT AS level, surface FROM t",
        "preterminal_paths": f"{LEAVES} SELECT document_id, sentence_index, terminal_index AS t, array_to_string(preterminal_path, '.') AS path FROM t",
        "surface_words": f"""{LEAVES} SELECT s.document_id, s.sentence_index, CASE WHEN whole THEN coalesce(string_agg(word, ' ' ORDER BY terminal_index) FILTER (WHERE surface >= 0), '') END AS words
FROM sentence s LEFT JOIN t USING (document_id, sentence_index) GROUP BY s.document_id, s.sentence_index, whole""",
        "pointer_parse": f"""
WITH p AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN (user_id % 50) || ':' || (event_id % 4) || [{", ".join(f"'{e}'" for e in POINTER_ENDS)}][event_id % {len(POINTER_ENDS)} + 1] ELSE '' END AS raw FROM events),
e AS (SELECT *, CASE WHEN raw = '' THEN 'pointer_empty' WHEN contains(raw, ';') AND contains(raw, '*') THEN 'mixed_semicolon_chain_unsupported' WHEN contains(raw, ';') AND contains(raw, ',') THEN 'mixed_concatenation_unsupported'
  WHEN NOT regexp_full_match(raw, '[0-9]+:[0-9]+([,;*][0-9]+:[0-9]+)*') THEN 'pointer_syntax_invalid' END AS pointer_error FROM p)
SELECT event_id, raw, pointer_error, if(pointer_error IS NULL, raw, NULL) AS members, if(pointer_error IS NULL, len(string_split(raw, '*')), 0)::INT AS n_members FROM e""",
        "pointer_resolution": f"""{LEAVES},
g AS (SELECT document_id, sentence_index, level, prefix, min(terminal_index) AS lo, count(*) AS nt, count(*) FILTER (WHERE surface >= 0) AS ns
  FROM (SELECT document_id, sentence_index, terminal_index, surface, level, preterminal_path[1:level] AS prefix FROM t, unnest(range(len(preterminal_path) + 1)) r(level)) GROUP BY ALL),
q AS (SELECT document_id, sentence_index, terminal_index AS t, h::INT AS h, len(preterminal_path) - h AS keep, CASE WHEN h <= len(preterminal_path) THEN preterminal_path[1:(len(preterminal_path) - h)] END AS prefix FROM t, range(4) r(h))
SELECT q.document_id, q.sentence_index, q.t, q.h, CASE WHEN keep < 0 THEN 'pointer_height_out_of_range' WHEN lo <> q.t THEN 'pointer_leftmost_terminal_mismatch' END AS pointer_error,
  CASE WHEN keep < 0 OR lo <> q.t THEN -1 ELSE nt END::INT AS nt, CASE WHEN keep < 0 OR lo <> q.t THEN -1 ELSE ns END::INT AS n_surface
FROM q LEFT JOIN g ON g.document_id = q.document_id AND g.sentence_index = q.sentence_index AND g.level = q.keep AND g.prefix = q.prefix""",
        "role_labels": r"""
WITH l AS (SELECT DISTINCT tag[3:] AS raw_label FROM (SELECT unnest(tags) AS tag FROM srl_examples) WHERE tag <> 'O')
SELECT raw_label, CASE WHEN core THEN regexp_extract(raw_label, '^((?:C-|R-)?ARG(?:[0-9]+|A))', 1) WHEN modi THEN raw_label END AS model_label,
  CASE WHEN core THEN nullif(regexp_extract(raw_label, '^(?:C-|R-)?ARG(?:[0-9]+|A)-(.+)$', 1), '') WHEN modi THEN regexp_extract(raw_label, 'ARGM-(.+)$', 1) END AS feature,
  CASE WHEN core OR modi THEN NULL WHEN raw_label IN ('ARGM', 'C-ARGM', 'R-ARGM') THEN 'argm_feature_missing' ELSE 'unsupported_role' END AS reason_code
FROM (SELECT *, regexp_full_match(raw_label, '(C-|R-)?ARG([0-9]+|A)(-[A-Za-z0-9][A-Za-z0-9_.-]*)?') AS core,
  regexp_full_match(raw_label, '(C-|R-)?ARGM-[A-Za-z0-9][A-Za-z0-9_.-]*') AS modi FROM l WHERE raw_label <> '')""",
        "prop_records": f"""{RECORDS}
SELECT rid AS example_id, doc AS document_id, si AS sentence_index, roleset, CASE WHEN typed THEN 'modern' ELSE 'classic' END AS dialect, kind, n_labels,
  coalesce(texts, '') AS labels, record_error FROM rec3 LEFT JOIN (SELECT rid, string_agg(label || '|' || raw, ' ' ORDER BY k) AS texts FROM lab2 GROUP BY rid) USING (rid)""",
        "subword_alignment": f"""
WITH ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS rn FROM (SELECT DISTINCT example_id, words, tags, predicate_index FROM srl_examples)) WHERE rn = 1),
ids(label, id) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in LABEL_IDS.items())}),
w AS (SELECT example_id, unnest(words) AS word, unnest(tags) AS tag, unnest(range(len(words))) AS pos, predicate_index FROM ex),
piece AS (SELECT w.*, k, if(k = 0 OR tag = 'O', tag, 'I-' || tag[3:]) AS label FROM w, unnest(range(greatest(1, ceil(length(coalesce(word, '')) / 4))::BIGINT)) r(k)),
c AS (SELECT example_id, count(*) AS pieces, bool_or(NOT regexp_full_match(tag, '(?s)O|[BI]-.+')) AS bad, bool_or(id IS NULL) AS missing, string_agg(id, ' ' ORDER BY pos, k) AS labels,
  string_agg((k = 0 AND pos = predicate_index)::INT, ' ' ORDER BY pos, k) AS indicator FROM piece LEFT JOIN ids USING (label) GROUP BY example_id),
e AS (SELECT ex.example_id, pieces, labels, indicator, CASE WHEN pieces IS NULL THEN 'align_words_empty' WHEN bad THEN 'align_tag_malformed' WHEN missing THEN 'align_label_unmapped' END AS align_error FROM ex LEFT JOIN c USING (example_id))
SELECT example_id, align_error, (coalesce(pieces, 0) + 2)::INT AS n_pieces, CASE WHEN align_error IS NULL THEN '-100 ' || labels || ' -100' END AS labels, CASE WHEN align_error IS NULL THEN '0 ' || indicator || ' 0' END AS indicator FROM e""",
        "alignment_errors": f"""
WITH ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id) AS rn FROM (SELECT DISTINCT example_id, words, tags, predicate_index FROM srl_examples)) WHERE rn = 1),
e AS (SELECT example_id, len(words) AS n, CASE WHEN coalesce(len(words), 0) = 0 THEN 'align_words_empty' WHEN len(list_filter(tags, lambda t: NOT regexp_full_match(t, '(?s)O|[BI]-.+'))) > 0 THEN 'align_tag_malformed'
  WHEN len(words) % 6 = 4 THEN 'align_ids_mismatch' WHEN len(words) % 6 = 3 THEN 'align_word_unknown' WHEN len(words) % 6 IN (1, 2) THEN 'align_words_omitted'
  WHEN len(list_filter(tags, lambda t: NOT list_contains([{", ".join(f"'{k}'" for k in LABEL_IDS)}], t))) > 0 THEN 'align_label_unmapped' END AS align_error FROM ex)
SELECT example_id, align_error, if(align_error IS NULL, n, -1)::INT AS n_labels FROM e""",
        "conversion_outcomes": f"{OUTCOMES} SELECT record_id, document_id, reason_code FROM out_",
        "coverage_report": f"{OUTCOMES} SELECT reason_code, count(*)::BIGINT AS records, round(count(*) / (SELECT count(*) FROM out_), 6) AS share FROM out_ GROUP BY reason_code",
        "bio_from_pointers": f"{OUTCOMES} SELECT record_id AS example_id, pos, tag FROM tagged",
        "conversion_provenance": OUTCOMES + conversion_sql.PROVENANCE,
        "record_cases": f"{CASE_OUTCOMES} SELECT raw_line, record_id, reason_code FROM out_",
        "record_case_coverage": f"{CASE_OUTCOMES} SELECT reason_code, count(*)::BIGINT AS records, round(count(*) / (SELECT count(*) FROM out_), 6) AS share FROM out_ GROUP BY reason_code",
        "record_case_tags": f"{CASE_OUTCOMES} SELECT record_id AS example_id, pos, tag FROM tagged",
        "record_case_provenance": CASE_OUTCOMES + conversion_sql.PROVENANCE,
        "role_base_anti": """
WITH l AS (SELECT DISTINCT example_id, CASE WHEN tag = 'O' THEN '' ELSE tag[3:] END AS label FROM (SELECT example_id, unnest(tags) AS tag FROM srl_examples))
SELECT example_id, label FROM l WHERE regexp_matches(label, '^[CR]-') AND NOT EXISTS (FROM l b WHERE b.example_id = l.example_id AND b.label = l.label[3:])""",
    }
