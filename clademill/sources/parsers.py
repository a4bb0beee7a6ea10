"""Parsers of alignment and tree files: FASTA, NEXUS, PHYLIP, Newick. Plain functions, used by the data source, the SQL table functions and tests."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class FormatError(ValueError):
    """A file that isn't what it should be."""


def sniff(text: str) -> str:
    """fasta, nexus or phylip; FormatError for formats that aren't read."""
    head = text.lstrip("﻿ \t\r\n")
    first = head.split("\n", 1)[0].strip()
    if first.upper().startswith("#NEXUS") or re.match(r"begin\s+\w+\s*;", first, re.I):
        return "nexus"
    if first.upper().startswith("# STOCKHOLM"):
        raise FormatError("Stockholm alignments are not read; convert to FASTA")
    if head.startswith(">"):
        return "fasta"
    if head.startswith("("):
        raise FormatError("this is a bare Newick tree, not an alignment")
    if re.fullmatch(r"\d+\s+\d+.*", first):
        return "phylip"
    return "fasta"


def parse_fasta(text: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = []
    for line in text.splitlines():
        line = line.strip()
        if not line or (line.startswith("#") and not out):
            continue
        if line.startswith(">"):
            out.append((line[1:].strip(), []))
        elif out:
            out[-1][1].append(re.sub(r"\s", "", line))
        else:
            raise FormatError("FASTA text before the first header")
    return [(name, "".join(parts)) for name, parts in out]


def parse_phylip(text: str) -> list[tuple[str, str]]:
    """Sequential or interleaved, names up to the first blank."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or not (m := re.match(r"\s*(\d+)\s+(\d+)", lines[0])):
        raise FormatError("no PHYLIP header")
    taxa, length = int(m[1]), int(m[2])
    rest, names, seqs = lines[1:], [], []
    named = r"\s*(\S+)\s+(\S.*)"
    together = len(rest) >= taxa and all(re.match(named, x) for x in rest[:taxa])  # all names in the first block: interleaved, or a line each
    for k, line in enumerate(rest):
        begins = k < taxa if together else len(names) < taxa and (not seqs or len(seqs[-1]) >= length)
        if begins:
            name, _, seq = line.strip().partition(" ")
            names.append(name)
            seqs.append(re.sub(r"\s", "", seq))
        else:
            seqs[k % taxa if together else -1] += re.sub(r"\s", "", line)
    if len(names) != taxa or any(len(s) != length for s in seqs):
        raise FormatError(f"PHYLIP header says {taxa} x {length}")
    return list(zip(names, seqs, strict=True))


def strip_comments(text: str) -> str:
    """NEXUS text without [comments], which may be nested; quoted text stays."""
    out, depth, quoted = [], 0, False
    for c in text:
        if c == "'" and not depth:
            quoted = not quoted
        if not quoted and c == "[":
            depth += 1
        elif not quoted and c == "]" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out)


def unquote(name: str) -> str:
    name = name.strip()
    return name[1:-1].replace("''", "'") if len(name) >= 2 and name[0] == name[-1] == "'" else name


@dataclass
class Nexus:
    sequences: list[tuple[str, str]] = field(default_factory=list)
    trees: list[tuple[str, str]] = field(default_factory=list)


def _block(text: str, name: str) -> str | None:
    m = re.search(rf"begin\s+{name}\s*;(.*?)end(?:block)?\s*;", text, re.I | re.S)
    return m[1] if m else None


def _command(block: str, name: str) -> str | None:
    m = re.search(rf"(?:^|;)\s*{name}\b([^;]*);", block, re.I | re.S)
    return m[1] if m else None


def parse_nexus(text: str) -> Nexus:
    """Data or characters, taxon labels, interleaved or not, with or without labels; trees with their translation done."""
    text = strip_comments(text)
    out = Nexus()
    taxa_block, labels = _block(text, "taxa"), []
    for block in (taxa_block, _block(text, "characters"), _block(text, "data")):
        if block and (found := _command(block, "taxlabels")):
            labels = [unquote(x) for x in re.findall(r"'(?:[^']|'')*'|\S+", found)]
    for name in ("data", "characters"):
        block = _block(text, name)
        if not block or (matrix := _command(block, "matrix")) is None:
            continue
        options = _command(block, "format") or ""
        dims = _command(block, "dimensions") or ""
        length = int(m[1]) if (m := re.search(r"nchar\s*=\s*(\d+)", dims, re.I)) else None
        rows: dict[str, list[str]] = {}
        order: list[str] = []
        if re.search(r"nolabels", options, re.I):
            bare = [re.sub(r"\s", "", x) for x in matrix.splitlines() if x.strip()]
            if not labels:
                raise FormatError("NOLABELS without TAXLABELS")
            for k, seq in enumerate(bare):
                rows.setdefault(labels[k % len(labels)], []).append(seq)
            order = labels
        else:
            current = None
            for line in matrix.splitlines():
                if not line.strip():
                    continue
                m = re.match(r"\s*('(?:[^']|'')*'|\S+)\s*(.*)", line)
                label, seq = unquote(m[1]), re.sub(r"\s", "", m[2])
                if seq or label in rows or length is None or (labels and label in labels):
                    current = label
                    if label not in rows:
                        order.append(label)
                    rows.setdefault(label, []).append(seq)
                elif current is not None and sum(map(len, rows[current])) < length:
                    rows[current].append(re.sub(r"\s", "", line))
                else:
                    current = label
                    order.append(label)
                    rows[label] = []
        found = [(n, "".join(rows[n])) for n in order if n in rows]
        if m := re.search(r"matchchar\s*=\s*(\S)", options, re.I):
            found = [(n, "".join(f if c == m[1] else c for c, f in zip(s, found[0][1], strict=False))) for n, s in found]
        if length is not None and any(len(s) != length for _, s in found):
            raise FormatError(f"NCHAR is {length}, but sequences have {sorted({len(s) for _, s in found})}")
        out.sequences = found
    if block := _block(text, "trees"):
        names = {}
        if (table := _command(block, "translate")) is not None:
            for item in table.split(","):
                key, _, value = item.strip().partition(" ")
                names[key.strip()] = unquote(value)
        for m in re.finditer(r"(?:^|;)\s*u?tree\s+\*?\s*([^=;]+?)\s*=\s*([^;]+;)", block, re.I | re.S):
            newick = m[2].strip()
            if names:
                newick = re.sub(r"(?<=[(,])\s*([^():,;{}\s]+)", lambda x: quote(names.get(x[1], x[1])), newick)
            out.trees.append((unquote(m[1]), newick))
    return out


def quote(name: str) -> str:
    """A label as Newick wants it."""
    return name if re.fullmatch(r"[^\s()\[\]{}:;,'\"]*", name) else "'" + name.replace("'", "''") + "'"


def parse_alignment(text: str) -> list[tuple[str, str]]:
    kind = sniff(text)
    found = parse_nexus(text).sequences if kind == "nexus" else parse_phylip(text) if kind == "phylip" else parse_fasta(text)
    if not found:
        raise FormatError("no sequences")
    names = [n for n, _ in found]
    if len(set(names)) < len(names):
        raise FormatError(f"duplicate name: {next(n for n in names if names.count(n) > 1)}")
    return found


def check_rectangular(found: list[tuple[str, str]], codons: bool = True) -> None:
    sizes = {len(s) for _, s in found}
    if len(sizes) > 1:
        raise FormatError(f"sequences differ in length: {sorted(sizes)}")
    if codons and sizes and next(iter(sizes)) % 3:
        raise FormatError(f"length {next(iter(sizes))} is no multiple of 3")


# Trees.


@dataclass
class Node:
    id: int
    parent: int
    name: str = ""
    length: float | None = None
    tag: str = ""
    children: list[int] = field(default_factory=list)

    @property
    def leaf(self) -> bool:
        return not self.children


class Tree:
    """Nodes by number; the root is 0. Every other node is the branch above it."""

    def __init__(self, nodes: list[Node]) -> None:
        self.nodes = nodes

    @classmethod
    def parse(cls, newick: str) -> Tree:
        """Newick with branch lengths and {tags}, quoted labels and [comments]; a NEXUS file gives its first tree."""
        if newick.lstrip().upper().startswith("#NEXUS"):
            trees = parse_nexus(newick).trees
            if not trees:
                raise FormatError("no tree in the file")
            newick = trees[0][1]
        text = re.sub(r"\[[^\]]*\]", "", newick).strip()
        if not text.startswith("("):
            raise FormatError("a tree begins with (")
        nodes = [Node(0, -1)]
        at, current = 0, 0
        token = re.compile(r"'((?:[^']|'')*)'|\{([^}]*)\}|:\s*([-+0-9.eE]+)|([^\s(),:;{}']+)|(\()|(\))|(,)|(;)|(\s+)")
        depth = 0
        while at < len(text):
            m = token.match(text, at)
            if not m:
                raise FormatError(f"unexpected {text[at]!r} in tree at {at}")
            at = m.end()
            quoted, tag, length, bare, opens, closes, comma, end, _ = m.groups()
            if quoted is not None or bare is not None:
                nodes[current].name = (quoted or "").replace("''", "'") if bare is None else bare
            elif tag is not None:
                nodes[current].tag = tag
            elif length is not None:
                nodes[current].length = float(length)
            elif opens:
                depth += 1
                nodes.append(Node(len(nodes), current))
                nodes[current].children.append(nodes[-1].id)
                current = nodes[-1].id
            elif comma or closes:
                if depth == 0:
                    raise FormatError("unbalanced tree")
                if comma:
                    parent = nodes[current].parent
                    nodes.append(Node(len(nodes), parent))
                    nodes[parent].children.append(nodes[-1].id)
                    current = nodes[-1].id
                else:
                    depth -= 1
                    current = nodes[current].parent
            elif end:
                break
        if depth:
            raise FormatError("unbalanced tree")
        return cls(nodes)

    def postorder(self) -> list[int]:
        out, stack = [], [0]
        while stack:
            k = stack.pop()
            out.append(k)
            stack.extend(self.nodes[k].children)
        return out[::-1]

    def leaves(self) -> list[int]:
        return [n.id for n in self.nodes if n.leaf]

    def rows(self, tree_id: str = "") -> list[tuple]:
        """(tree_id, node_id, parent_id, name, branch_length, is_leaf, tag, post_order)."""
        order = {k: j for j, k in enumerate(self.postorder())}
        return [(tree_id, n.id, n.parent if n.parent >= 0 else None, n.name, n.length, n.leaf, n.tag, order[n.id]) for n in self.nodes]

    def newick(self, node: int = 0, *, tags: bool = True, lengths: bool = True) -> str:
        parts: dict[int, str] = {}
        for k in self.postorder():
            n = self.nodes[k]
            inner = f"({','.join(parts.pop(c) for c in n.children)})" if n.children else ""
            parts[k] = inner + quote(n.name) + (f"{{{n.tag}}}" if tags and n.tag else "") + (f":{n.length:.10g}" if lengths and n.length is not None and k else "")
        return parts[node] + ";"

    def unrooted(self) -> Tree:
        """A root with two children loses the one that isn't a leaf, its length going to the other."""
        root = self.nodes[0]
        if len(root.children) != 2:
            return self
        inner = next((c for c in root.children if not self.nodes[c].leaf), None)
        if inner is None:
            return self
        other = next(c for c in root.children if c != inner)
        total = (self.nodes[inner].length or 0) + (self.nodes[other].length or 0)
        copy = [Node(n.id, n.parent, n.name, n.length, n.tag, list(n.children)) for n in self.nodes]
        copy[other].length = total
        copy[0].children = [c for c in root.children if c != inner] + copy[inner].children
        for c in copy[inner].children:
            copy[c].parent = 0
        keep = [n for n in copy if n.id != inner]
        number = {n.id: k for k, n in enumerate(keep)}
        return Tree([Node(number[n.id], number.get(n.parent, -1), n.name, n.length, n.tag, [number[c] for c in n.children]) for n in keep])

    def prune(self, names: set[str]) -> Tree:
        """The tree of the named leaves; nodes left with one child are joined with it, lengths added."""
        keep: dict[int, list[int]] = {}
        for k in self.postorder():
            n = self.nodes[k]
            if n.leaf:
                if n.name in names:
                    keep[k] = []
            elif inner := [c for c in n.children if c in keep]:
                keep[k] = inner
        if not keep:
            raise ValueError("no leaf is left")

        out: list[Node] = []

        def add(k: int, parent: int, extra: float | None) -> None:
            n = self.nodes[k]
            length = n.length if extra is None else (n.length or 0) + extra
            if len(keep[k]) == 1:
                add(keep[k][0], parent, length if parent >= 0 else None)
                return
            here = Node(len(out), parent, n.name, length, n.tag)
            out.append(here)
            if parent >= 0:
                out[parent].children.append(here.id)
            for c in keep[k]:
                add(c, here.id, None)

        add(0, -1, None)
        out[0].length = None
        return Tree(out)

    def bipartitions(self) -> set[frozenset[str]]:
        """Non-trivial splits, each as the side without the first leaf in order."""
        every = frozenset(self.nodes[k].name for k in self.leaves())
        first, out, below = min(every), set(), {}
        for k in self.postorder():
            n = self.nodes[k]
            below[k] = frozenset([n.name]) if n.leaf else frozenset().union(*(below[c] for c in n.children))
            side = every - below[k] if first in below[k] else below[k]
            if k and 1 < len(side) < len(every) - 1:
                out.add(side)
        return out


def robinson_foulds(one: Tree, two: Tree) -> int:
    return len(one.bipartitions() ^ two.bipartitions())


FOREGROUND, BACKGROUND = {"t", "test", "foreground", "fg"}, {"r", "ref", "reference", "background", "bg"}


def select_branches(tree: Tree, spec: str = "All", *, regex: str = "", names: list[str] | None = None, auto: bool = False, strict: bool = True) -> list[bool]:
    """Which nodes (never the root) a specification means.

    All (with `auto`, only the test branches where some are tagged so), All-Branches, Internal, Leaves, Unlabeled, a list of names, tags and keywords, one name or tag
    (test and reference have synonyms), and a regular expression where nothing matches and it looks like one. Nothing selected is an error if strict."""
    bare = lambda s: (m[1] if (m := re.fullmatch(r"\{(.*)\}", s.strip(), re.S)) else s).strip()
    spec, mode = spec.strip(), bare(spec).lower()
    nodes = tree.nodes[1:]

    def kin(tag: str, words: set[str]) -> bool:
        return any(tag in group and words & group for group in (FOREGROUND, BACKGROUND))

    def matches(pattern: str) -> list[bool]:
        found = re.compile(pattern, re.I)
        return [bool(found.search(n.name) or (n.tag and found.search(n.tag))) for n in nodes]

    def of(words: set[str], keywords: bool) -> list[bool]:
        out = []
        for n in nodes:
            name, tag = n.name.lower(), n.tag.lower()
            hit = name in words or bool(tag) and (tag in words or kin(tag, words))
            if keywords:
                hit |= "internal" in words and not n.leaf or bool(words & {"leaves", "terminal"}) and n.leaf or bool(words & {"unlabeled", "untagged"}) and not tag
            out.append(hit)
        return out

    if regex:
        chosen = matches(regex)
    elif names:
        words = {bare(x).lower() for x in names} - {""}
        chosen = [n.name.lower() in words or bool(n.tag) and n.tag.lower() in words for n in nodes]
    elif mode in ("", "all"):
        tagged = [n.tag.lower() in FOREGROUND for n in nodes]
        chosen = tagged if auto and any(tagged) else [True] * len(nodes)
    elif mode in ("all-branches", "all_branches"):
        chosen = [True] * len(nodes)
    elif mode == "internal":
        chosen = [not n.leaf for n in nodes]
    elif mode in ("leaves", "terminal", "tips"):
        chosen = [n.leaf for n in nodes]
    elif mode in ("unlabeled", "untagged"):
        chosen = [not n.tag for n in nodes]
    elif "," in mode:
        chosen = of({bare(x) for x in mode.split(",")} - {""}, True)
    else:
        chosen = of({mode}, False)
        if not any(chosen) and set(spec) & set(".*+?^$[]()|\\"):
            chosen = matches(spec)
    if strict and not any(chosen):
        raise ValueError(f"no branch matches {regex or names or spec!r}")
    return [False, *chosen]


def propagate_labels(tree: Tree, leaf_label: dict[str, str], how: str = "all") -> dict[int, str]:
    """Labels of all nodes from those of the leaves: all (a clade of one label), parsimony (Fitch), mrca, only (leaves), none."""
    label = {k: leaf_label.get(tree.nodes[k].name, "") for k in tree.leaves()}
    if how == "none":
        return {}
    if how == "only":
        return {k: v for k, v in label.items() if v}
    if how == "mrca":
        out = dict(label)
        for name in set(label.values()) - {""}:
            inside = {k for k, v in label.items() if v == name}
            path: dict[int, int] = {}
            for k in inside:
                while k >= 0:
                    path[k] = path.get(k, 0) + 1
                    k = tree.nodes[k].parent
            out.update({k: name for k, n in path.items() if n == len(inside) and all(path.get(c, 0) < n for c in tree.nodes[k].children)})
        return {k: v for k, v in out.items() if v}
    states: dict[int, set[str]] = {}
    for k in tree.postorder():
        n = tree.nodes[k]
        if n.leaf:
            states[k] = {label[k]}
        else:
            below = [states[c] for c in n.children]
            common = set.intersection(*below)
            states[k] = (common or set.union(*below)) if how == "parsimony" else (common if all(len(b) == 1 for b in below) and common else {""})
    chosen: dict[int, str] = {}
    for k in reversed(tree.postorder()):
        up = chosen.get(tree.nodes[k].parent)
        chosen[k] = up if up in states[k] else min(states[k])
    return {k: v for k, v in chosen.items() if v}
