"""Bracketed constituency trees as tables.

A tree has no recursive type here: nodes are ``(level, label, lt, nt)``, where a node covers the terminals
``[lt, lt + nt)`` and the root has level 0. With that, a pointer is an equality on ``(lt, level)``. Nodes stand in the order
of the text, so the ancestors of a terminal that begin with it stand right before its own ``node``, and no path is
walked or searched. One pass with an explicit stack per text runs inside the scan (a map, no shuffle), where a window form
would have to explode, shuffle and sort every bracket; depth is not limited by recursion.

Error codes in order of what is met first: ``tree_source_empty``, ``tree_syntax_invalid``,
``nested_unlabeled_wrapper_invalid``, ``unlabeled_tree_wrapper_invalid``, ``tree_structure_invalid``; for texts
that must hold one tree also ``tree_count_invalid``. The first error fails the whole text.

Defined results: a null text is an empty one; an unlabeled pair of brackets around a whole tree is dropped;
repeated rows are parsed each; words and labels of any length are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatlas.session import ship

TOKEN = re.compile(r"[()]|[^\s()]+")
EMPTY = "-NONE-"

NODE = "struct<level:int,label:string,lt:int,nt:int>"
TERMINAL = "struct<word:string,pos:string,level:int,surface:int,node:int,path:array<int>>"


class TreeError(Exception):
    """A text that is no sequence of trees; ``args[0]`` is the code."""


def scan_trees(source: str) -> list[tuple[list[tuple], list[tuple]]]:
    """Nodes and terminals of every tree of a text; raises TreeError at the first violation.

    The path of a terminal has the number of each node on the way from the root among its siblings.
    """
    pieces = TOKEN.findall(source)
    if not pieces:
        raise TreeError("tree_source_empty")
    trees = []
    at, n = 0, len(pieces)
    while at < n:
        wrapped = pieces[at : at + 2] == ["(", "("]
        at = at + 1 if wrapped else at
        if pieces[at] != "(":
            raise TreeError("tree_syntax_invalid")
        nodes: list[list] = []
        terminals: list[tuple] = []
        surface = 0
        open_nodes: list[list] = []  # [number of the node, words, child nodes]
        while True:
            piece = pieces[at] if at < n else None
            if piece is None:
                raise TreeError("tree_syntax_invalid")
            if piece == "(":
                label = pieces[at + 1] if at + 1 < n else None
                if label == "(":
                    raise TreeError("nested_unlabeled_wrapper_invalid")
                if label is None or label == ")":
                    raise TreeError("tree_syntax_invalid")
                if open_nodes:
                    open_nodes[-1][2] += 1
                nodes.append([len(open_nodes), label, len(terminals), 0])
                open_nodes.append([len(nodes) - 1, [], 0])
                at += 2
            elif piece == ")":
                number, words, children = open_nodes.pop()
                if bool(words) == bool(children) or len(words) > 1:
                    raise TreeError("tree_structure_invalid")
                if words:
                    empty = nodes[number][1] == EMPTY
                    path = [o[2] - 1 for o in open_nodes]
                    terminals.append((words[0], nodes[number][1], nodes[number][0], None if empty else surface, number, path))
                    surface += not empty
                nodes[number][3] = len(terminals) - nodes[number][2]
                at += 1
                if not open_nodes:
                    break
            else:
                open_nodes[-1][1].append(piece)
                at += 1
        if wrapped:
            if at >= n or pieces[at] != ")":
                raise TreeError("unlabeled_tree_wrapper_invalid")
            at += 1
        trees.append(([tuple(x) for x in nodes], terminals))
    return trees


def parse_trees(df: DataFrame, source_col: str, *keys: str, single: bool = False) -> DataFrame:
    """``(keys, tree_no, nodes, terminals, tree_error)``: one row per tree, or one row with the error of a text.

    With ``single`` a text must hold exactly one tree.
    """
    ship(df.sparkSession)
    count = len(keys)
    node_names, terminal_names = ("level", "label", "lt", "nt"), ("word", "pos", "level", "surface", "node", "path")
    node_types = (pa.int32(), pa.string(), pa.int32(), pa.int32())
    terminal_types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))

    def lists(rows: list[list[tuple] | None], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.ListArray:
        """Rows of tuples as an array of lists of structs, column by column."""
        offsets, at = [], 0
        for row in rows:
            offsets.append(None if row is None else at)
            at += len(row or ())
        columns = list(zip(*(x for row in rows for x in row or ()))) or [()] * len(names)
        return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, nodes, terminals, errors = [], [], [], [], []
            for i, source in enumerate(batch.column(count).to_pylist()):
                try:
                    trees = scan_trees(source or "")
                    if single and len(trees) != 1:
                        raise TreeError("tree_count_invalid")
                    found = [(k, *tree, None) for k, tree in enumerate(trees)]
                except TreeError as error:
                    found = [(0, None, None, error.args[0])]
                for k, n, t, e in found:
                    owner.append(i)
                    number.append(k)
                    nodes.append(n)
                    terminals.append(t)
                    errors.append(e)
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(count)), pa.array(number, pa.int32()), lists(nodes, node_names, node_types), lists(terminals, terminal_names, terminal_types), pa.array(errors, pa.string())],
                [*keys, "tree_no", "nodes", "terminals", "tree_error"],
            )

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, tree_no int, nodes array<{NODE}>, terminals array<{TERMINAL}>, tree_error string"
    return df.select(*keys, source_col).mapInArrow(kernel, schema)


def nodes_long(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per node in order of the text: ``node, level, label, lt, nt``."""
    return parsed.select(*keys, "tree_no", F.posexplode("nodes").alias("node", "n")).select(*keys, "tree_no", "node", "n.level", "n.label", "n.lt", "n.nt")


def terminals_long(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per terminal: ``t, word, pos, level, surface`` (null for empty elements)."""
    return parsed.select(*keys, "tree_no", F.posexplode("terminals").alias("t", "x")).select(*keys, "tree_no", "t", "x.word", "x.pos", "x.level", "x.surface")


def surface_words(terminals: Column) -> Column:
    """The words of a tree without empty elements."""
    return F.transform(F.filter(terminals, lambda t: t["surface"].isNotNull()), lambda t: t["word"])


def preterminal_paths(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per terminal with the child numbers that lead to its preterminal from the root."""
    return parsed.select(*keys, "tree_no", F.posexplode("terminals").alias("t", "x")).select(*keys, "tree_no", "t", "x.path")


def balanced_counts(df: DataFrame, source_col: str, *keys: str) -> DataFrame:
    """``(keys, sentences, terminals array<int>, tree_error)``: top-level bracket groups and preterminals in
    each, without reading labels. Errors: ``unmatched_closing_parenthesis``, ``unclosed_parenthesis``,
    ``no_balanced_trees``, ``tree_without_terminal``."""
    ship(df.sparkSession)
    count, leaf = len(keys), re.compile(r"\([^()\s]+\s+[^()\s]+\)")

    def counts(source: str) -> list[int]:
        depth, begin, found = 0, 0, []
        for bracket in re.finditer(r"[()]", source):
            if bracket.group() == "(":
                begin = bracket.start() if depth == 0 else begin
                depth += 1
                continue
            depth -= 1
            if depth < 0:
                raise TreeError("unmatched_closing_parenthesis")
            if depth == 0:
                found.append(sum(1 for _ in leaf.finditer(source, begin, bracket.end())))
        if depth:
            raise TreeError("unclosed_parenthesis")
        if not found:
            raise TreeError("no_balanced_trees")
        if 0 in found:
            raise TreeError("tree_without_terminal")
        return found

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for source in batch.column(count).to_pylist():
                try:
                    found.append(counts(source or ""))
                    errors.append(None)
                except TreeError as error:
                    found.append(None)
                    errors.append(error.args[0])
            sizes = [None if f is None else len(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(count)), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(errors, pa.string())],
                [*keys, "sentences", "terminals", "tree_error"],
            )

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, source_col).mapInArrow(kernel, f"{types}, sentences int, terminals array<int>, tree_error string")
