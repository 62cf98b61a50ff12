"""Trees: a directory of Newick or NEXUS texts becomes a node table; texts that are no tree become rows with a reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed

_TOKEN = re.compile(r"'(?:[^']|'')*'|\[[^\]]*\]|[(),;:]|[^(),;:\[\]'\s]+")
SCHEMA = "tree_id long, node_id long, parent_id long, name string, branch_length double, depth int, ord int"


def newick_nodes(text: str) -> list[tuple]:
    """``(node_id, parent_id, name, branch_length, depth, ord)`` in order of appearance."""
    nodes: list[list] = [[0, None, None, None, 0, 0]]
    at, length_next = 0, False
    for token in _TOKEN.findall(text):
        if token.startswith("["):
            continue
        if token == "(":
            nodes.append([len(nodes), at, None, None, nodes[at][4] + 1, len(nodes)])
            at = len(nodes) - 1
        elif token == ",":
            parent = nodes[at][1]
            nodes.append([len(nodes), parent, None, None, nodes[parent][4] + 1, len(nodes)])
            at = len(nodes) - 1
        elif token == ")":
            at = nodes[at][1]
        elif token == ":":
            length_next = True
        elif token == ";":
            break
        elif length_next:
            nodes[at][3], length_next = float(token), False
        else:
            nodes[at][2] = token.strip("'").replace("''", "'")
    return [tuple(n) for n in nodes]


def parse_trees(texts: DataFrame) -> DataFrame:
    """``texts(tree_id, newick)`` -> ``tree_node``; a text is one row, parsed in its task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(t, *n) for t, text in zip(batch["tree_id"], batch["newick"], strict=True) for n in newick_nodes(text)]
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield frame.astype({"parent_id": "Int64", "branch_length": "Float64"})

    return texts.select("tree_id", "newick").mapInPandas(parse, SCHEMA)


_LABEL = re.compile(r"[A-Za-z0-9_.-]+")
_BLOCK = re.compile(r"begin\s+trees\s*;(.*?)\bend(?:block)?\s*;", re.I | re.S)
_COMMAND = re.compile(r"(?:'(?:[^']|'')*'|\[[^\]]*\]|[^;'\[])+")
_TREE = re.compile(r"u?tree\s*\*?\s*('(?:[^']|'')*'|[^\s=]+)\s*=\s*(.*)", re.I | re.S)
_PAIR = re.compile(r"\s*('(?:[^']|'')*'|[^\s,]+)\s+('(?:[^']|'')*'|[^\s,]+)\s*")
_PLAIN = lambda x: x[1:-1].replace("''", "'") if x[:1] == "'" else x


def tree_fault(newick: str) -> str | None:
    """Why a text is no Newick tree, or nothing."""
    text = newick.strip()
    if "(" not in text:
        return None if _LABEL.fullmatch(text.rstrip(";").strip()) else "no tree"
    depth = labels = 0
    before, expects_length = "", False
    for token in _TOKEN.findall(text):
        if token.startswith("["):
            continue
        if expects_length:
            try:
                float(token)
            except ValueError:
                return "branch length is no number"
        elif token not in "(),:;" and before not in ("(", ",", ")", ""):
            return "label after label"
        labels += token not in "(),:;" and not expects_length
        depth += (token == "(") - (token == ")")
        if depth < 0:
            return "unbalanced brackets"
        if token == ";":
            break
        expects_length = token == ":"
        before = token
    return "unbalanced brackets" if depth else None if labels else "no labels"


def nexus_trees(text: str) -> tuple[list[tuple[str, str, dict[str, str]]], str | None]:
    """``(name, newick, translation)`` of a NEXUS text's trees, and why there are none."""
    block = _BLOCK.search(text)
    if not block:
        return [], "no block of trees"
    names: dict[str, str] = {}
    out = []
    for command in _COMMAND.findall(block[1]):
        command = command.strip()
        if command.lower().startswith("translate"):
            names = {_PLAIN(a): _PLAIN(b) for a, b in _PAIR.findall(command[9:])}
        elif found := _TREE.match(command):
            out.append((_PLAIN(found[1]), found[2].strip() + ";", names))
    return out, None if out else "no tree in the block"


def trees_of_text(text: str) -> list[tuple[str | None, str | None, dict[str, str], str | None]]:
    """``(name, newick, translation, fault)`` of a file: many trees of a NEXUS text, one of another."""
    if text.strip()[:6].upper() == "#NEXUS":
        found, fault = nexus_trees(text)
        return [(n, t, names, tree_fault(t)) for n, t, names in found] or [(None, None, {}, fault)]
    return [(None, text, {}, "empty" if not text.strip() else tree_fault(text))]


TREES = "file string, tree_no int, tree_name string, fault string, node_id long, parent_id long, name string, branch_length double, depth int, ord int"


def parse_tree_files(files: DataFrame) -> DataFrame:
    """``files(file, text)`` -> ``TREES``: a row per node of each tree, its leaves named as the file's translation
    says; a text or tree that can't be read is one row with a ``fault`` and no node. A file is parsed in its task."""
    columns = [c.split()[0] for c in TREES.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["text"], strict=True):
                for no, (tree, newick, names, fault) in enumerate(trees_of_text(text or "")):
                    if fault:
                        rows.append((file, no, tree, fault, *[None] * 6))
                    else:
                        rows += [(file, no, tree, None, n[0], n[1], names.get(n[2], n[2]), *n[3:]) for n in newick_nodes(newick)]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({c: "Int64" for c in ("tree_no", "node_id", "parent_id", "depth", "ord")} | {"branch_length": "Float64"})

    return files.select("file", "text").mapInPandas(parse, TREES)


def newick_texts(nodes: DataFrame) -> DataFrame:
    """``tree_node`` -> ``(tree_id, newick)``, level by level from the leaves; children in tree order."""
    quoted = F.when(F.col("name").rlike(r"^[A-Za-z0-9_.#-]*$"), F.col("name")).otherwise(F.concat(F.lit("'"), F.replace("name", F.lit("'"), F.lit("''")), F.lit("'")))
    label = F.concat(F.coalesce(quoted, F.lit("")), F.coalesce(F.concat(F.lit(":"), F.col("branch_length").cast("string")), F.lit("")))
    place = nodes.select("tree_id", "node_id", "parent_id", "depth", "ord", label.alias("label"))
    depths = sorted((r["depth"] for r in nodes.select("depth").distinct().collect()), reverse=True)  # levels of the tree
    below = None
    for k, depth in enumerate(depths, 1):
        here = place.filter(F.col("depth") == depth)
        here = here.withColumn("kids", F.lit(None).cast("string")) if below is None else here.join(below, ["tree_id", "node_id"], "left")
        text = here.select("tree_id", "parent_id", "ord", "node_id", F.concat(F.coalesce(F.concat(F.lit("("), "kids", F.lit(")")), F.lit("")), "label").alias("t"))
        if k % 4 == 0:
            text = checkpointed(text)
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node_id", "t"))), lambda x: x["t"]), ",")
        below = text.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(kids.alias("kids"))
    return text.select("tree_id", F.concat("t", F.lit(";")).alias("newick"))
