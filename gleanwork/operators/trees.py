"""Trees: context trees, whose paths are conjunctions of shared layers, and directory trees, whose nodes own their members.

A tree's nodes are few and live on the driver; documents are placed by membership keys, `context/<tree>/<layer>` and
`vfs/<tree>/<node>`, so that nothing about a document is kept here. `to_frame` gives the nodes as a table for joins on large trees.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys


def segment(name: str) -> str:
    """A path segment in its stored form: NFKC, single blanks, no control characters or slashes."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", str(name))).strip()
    return re.sub(r"[\x00-\x1f\x7f/\\:*?\"<>|]", "_", text)


def split(path: str) -> list[str]:
    return [segment(p) for p in str(path).replace("\\", "/").split("/") if p.strip()]


def same(a: str, b: str) -> bool:
    return a.casefold() == b.casefold()


@dataclass
class Layer:
    id: str
    name: str
    type: str = "context"
    holders: list[str] = field(default_factory=list)  # of locks
    spec: dict | None = None  # of a view: a stored query
    extra: dict = field(default_factory=dict)

    @property
    def locked(self) -> bool:
        return bool(self.holders)


@dataclass
class Node:
    name: str
    layer: Layer
    children: list[Node] = field(default_factory=list)
    holders: list[str] = field(default_factory=list)

    @property
    def locked(self) -> bool:
        return bool(self.holders)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if same(c.name, name)), None)


def _hold(holders: list[str], holder: str, on: bool) -> bool:
    """A lock taken or given back by its holder; it is open again when nobody holds it. Whether it is held."""
    if on and holder not in holders:
        holders.append(holder)
    elif not on and holder in holders:
        holders.remove(holder)
    return bool(holders)


class _Tree:
    kind = ""
    prefix = ""

    def __init__(self, id: str = "default", name: str | None = None):
        self.id, self.name, self.locked = id, name or id, False
        self._next = 0
        self.root = Node("/", self._layer("/"))

    def _layer(self, name: str, type: str = "context") -> Layer:
        self._next += 1
        return Layer(f"{self._next}", name, type)

    def node(self, path: str) -> Node | None:
        at = self.root
        for name in split(path):
            at = at.child(name)
            if at is None:
                return None
        return at

    def chain(self, path: str) -> list[Node] | None:
        out = [self.root]
        for name in split(path):
            nxt = out[-1].child(name)
            if nxt is None:
                return None
            out.append(nxt)
        return out

    def exists(self, path: str) -> bool:
        return self.node(path) is not None

    def key(self, layer: Layer) -> str:
        return keys.normalize(f"{self.prefix}/{self.id}/{layer.id}")

    def insert(self, path: str) -> Node:
        """Makes the missing nodes of a path."""
        at = self.root
        for name in split(path):
            nxt = at.child(name)
            if nxt is None:
                if at.locked or self.locked:
                    raise ValueError(f"{path} is locked")
                nxt = Node(name, self._layer_for(name))
                at.children.append(nxt)
            at = nxt
        return at

    def _layer_for(self, name: str) -> Layer:
        return self._layer(name)

    def remove(self, path: str, recursive: bool = False) -> Node:
        parts = split(path)
        if not parts:
            raise ValueError("the root stays")
        parent, node = self.node("/".join(parts[:-1])), self.node(path)
        if node is None:
            raise ValueError(f"no path {path}")
        if node.locked or node.layer.locked:
            raise ValueError(f"{path} is locked")
        if node.children and not recursive:
            parent.children.extend(node.children)
            node = Node(node.name, node.layer)
        parent.children[:] = [c for c in parent.children if not same(c.name, parts[-1])]
        return node

    def move(self, path: str, to: str) -> Node:
        """A node with all below it becomes a child of another, made where it is missing."""
        node = self.node(path)
        if node is None or node is self.root:
            raise ValueError(f"no path {path}")
        a, b = [x.casefold() for x in split(path)], [x.casefold() for x in split(to)]
        if b[: len(a)] == a:
            raise ValueError("a node can't move below itself")
        target = self.insert(to)
        if target.child(node.name):
            raise ValueError(f"{to} has a {node.name} already")
        self.node("/".join(split(path)[:-1])).children.remove(node)
        target.children.append(node)
        return node

    def lock(self, path: str, on: bool = True, holder: str = "user") -> bool:
        node = self.node(path)
        if node is None:
            raise ValueError(f"no path {path}")
        return _hold(node.holders, holder, on)

    def holders(self, path: str) -> list[str]:
        node = self.node(path)
        return [] if node is None else [*node.holders, *node.layer.holders]

    def update_node(self, path: str, **fields) -> Layer:
        """What a folder or layer carries besides its name."""
        node = self.node(path)
        if node is None:
            raise ValueError(f"no path {path}")
        if node.locked or node.layer.locked:
            raise ValueError(f"{path} is locked")
        node.layer.extra.update(fields)
        return node.layer

    def walk(self, at: Node | None = None, path: str = ""):
        at = at or self.root
        yield path or "/", at
        for c in at.children:
            yield from self.walk(c, f"{path}/{c.name}")

    def paths(self) -> list[str]:
        return sorted(p for p, _ in self.walk())

    def listing(self, path: str = "/") -> list[str]:
        node = self.node(path)
        return sorted(c.name for c in node.children) if node else []

    def find(self, name: str, under: str = "/", limit: int | None = None) -> list[str]:
        """Paths of nodes whose name holds a text, below a path, in order."""
        prefix = under.rstrip("/") + "/"
        out = sorted(p for p in self.paths() if p.startswith(prefix) and name.lower() in p.rsplit("/", 1)[-1].lower())
        return out if limit is None else out[:limit]

    def path_of(self, layer_id: str) -> str | None:
        return next((p for p, n in self.walk() if n.layer.id == layer_id), None)

    def to_json(self) -> str:
        def one(n: Node):
            return {"name": n.name, "layer": n.layer.__dict__, "holders": n.holders, "children": [one(c) for c in n.children]}

        return json.dumps({"kind": self.kind, "id": self.id, "name": self.name, "next": self._next, "locked": self.locked, "root": one(self.root)})

    @classmethod
    def from_json(cls, text: str):
        got = json.loads(text)
        tree = cls(got["id"], got["name"])
        layers: dict[str, Layer] = {}

        def one(d) -> Node:
            layer = layers.setdefault(d["layer"]["id"], Layer(**d["layer"]))
            return Node(d["name"], layer, [one(c) for c in d["children"]], d["holders"])

        tree.root, tree._next, tree.locked = one(got["root"]), got["next"], got["locked"]
        return tree

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """tree, path, parent, name, layer_id, type and key of every node."""
        rows = [(self.id, p, p.rsplit("/", 1)[0] or "/" if p != "/" else None, n.name, n.layer.id, n.layer.type, self.key(n.layer)) for p, n in self.walk()]
        return spark.createDataFrame(rows, "tree string, path string, parent string, name string, layer_id string, type string, key string")


class ContextTree(_Tree):
    """Layers are shared by name: two paths with the same leaf hold the same documents there."""

    kind, prefix = "context", "context"

    def __init__(self, id: str = "default", name: str | None = None):
        self.layers: dict[str, Layer] = {}
        super().__init__(id, name)
        self.layers["/"] = self.root.layer

    def insert(self, path: str) -> Node:
        """The nodes of a path; no layer may stand above itself."""
        above: list[Layer] = []
        for name in split(path):
            layer = self.layers.get(name.casefold())
            if layer is not None:
                if any(layer is x for x in above):
                    raise ValueError(f"layer {name} is above itself in {path}")
                above.append(layer)
        names = [x.casefold() for x in split(path)]
        if len(set(names)) < len(names):
            raise ValueError(f"a layer is above itself in {path}")
        return super().insert(path)

    def _layer_for(self, name: str) -> Layer:
        return self.layers.setdefault(name.casefold(), None) or self.layers.update({name.casefold(): self._layer(name)}) or self.layers[name.casefold()]

    @classmethod
    def from_json(cls, text: str):
        tree = super().from_json(text)
        tree.layers = {("/" if n is tree.root else n.layer.name.casefold()): n.layer for _, n in tree.walk()}
        return tree

    def keys_for(self, path: str, recursive: bool = False) -> list[str] | None:
        """The layer keys a document needs to be on a path; views don't count. None where the path isn't there."""
        chain = self.chain(path)
        if chain is None:
            return None
        below = [n for n in chain[1:] if n.layer.type != "view"]
        return list(dict.fromkeys(self.key(n.layer) for n in below)) or [self.key(self.root.layer)]

    def write_keys(self, paths: list[str]) -> list[str]:
        """The keys a document gets when it is put on paths: the root's and every layer's on the way."""
        out = [self.key(self.root.layer)]
        for p in paths:
            self.insert(p)
            out += [self.key(n.layer) for n in self.chain(p)[1:] if n.layer.type != "view"]
        return list(dict.fromkeys(out))

    def unlink_keys(self, path: str, recursive: bool = False) -> list[str]:
        """The keys a document loses: the leaf's, or with recursive every layer's on the path."""
        chain = self.chain(path)
        if chain is None or len(chain) == 1:
            raise ValueError("the root can't be unlinked")
        return [self.key(n.layer) for n in (chain[1:] if recursive else chain[-1:])]

    def layer(self, name: str) -> Layer | None:
        return self.layers.get(name.casefold())

    def rename_layer(self, name: str, to: str) -> Layer:
        layer = self._unlocked(name)
        if to.casefold() in self.layers:
            raise ValueError(f"there is a layer {to}")
        self.layers[to.casefold()] = self.layers.pop(name.casefold())
        layer.name = segment(to)
        for _, n in self.walk():
            if n.layer is layer:
                n.name = layer.name
        return layer

    def _unlocked(self, name: str) -> Layer:
        layer = self.layer(name)
        if layer is None:
            raise ValueError(f"no layer {name}")
        if layer.locked:
            raise ValueError(f"layer {name} is locked")
        return layer

    def update_layer(self, name: str, **fields) -> Layer:
        layer = self._unlocked(name)
        layer.extra.update(fields)
        return layer

    def convert_layer(self, name: str, type: str) -> Layer:
        layer = self._unlocked(name)
        layer.type = type
        return layer

    def lock_layer(self, name: str, on: bool = True, holder: str = "user") -> bool:
        layer = self.layer(name)
        if layer is None:
            raise ValueError(f"no layer {name}")
        return _hold(layer.holders, holder, on)

    def delete_layer(self, name: str) -> str:
        """Takes a layer out of the tree; returns the key whose membership goes with it."""
        layer = self._unlocked(name)
        for p in sorted((p for p, n in self.walk() if n.layer is layer), key=len, reverse=True):
            self.remove(p)
        del self.layers[name.casefold()]
        return self.key(layer)

    def view(self, path: str, spec: dict) -> Layer:
        """A node that stores a query and constrains nothing itself."""
        node = self.insert(path)
        node.layer.type, node.layer.spec = "view", spec
        return node.layer

    def copy(self, path: str, to: str) -> None:
        """The nodes below and at a path also below another one; layers are shared."""
        node = self.node(path)
        if node is None:
            raise ValueError(f"no path {path}")
        base = "/".join(split(to))
        for p, _ in list(self.walk(node, f"/{node.name}")):
            self.insert(f"{base}{p}")


class DirectoryTree(_Tree):
    """Each folder has its own members."""

    kind, prefix = "directory", "vfs"

    def keys_for(self, path: str, recursive: bool = False) -> list[str] | None:
        """The folder's key, with recursive those of all folders below too. None where the path isn't there."""
        node = self.node(path)
        if node is None:
            return None
        return [self.key(n.layer) for _, n in self.walk(node)] if recursive else [self.key(node.layer)]

    def write_keys(self, paths: list[str]) -> list[str]:
        return list(dict.fromkeys(self.key(self.insert(p).layer) for p in paths))

    def unlink_keys(self, path: str, recursive: bool = False) -> list[str]:
        if not split(path):
            raise ValueError("the root can't be unlinked")
        return self.keys_for(path, recursive) or []

    def copy(self, path: str, to: str) -> list[tuple[str, str]]:
        """A subtree below another folder; returns (key, new key) pairs whose membership is to be copied."""
        node = self.node(path)
        if node is None:
            raise ValueError(f"no path {path}")
        base, out = "/".join(split(to)), []
        for p, n in list(self.walk(node, f"/{node.name}")):
            out.append((self.key(n.layer), self.key(self.insert(f"{base}{p}").layer)))
        return out


def _layer_keys(tree: _Tree, names: list[str]) -> list[str]:
    layers = [tree.layer(n) for n in names]
    if None in layers:
        raise KeyError(f"no layer {names[layers.index(None)]}")
    return [tree.key(x) for x in layers]


def merge_layer(membership: DataFrame, tree: ContextTree, name: str, into: list[str]) -> DataFrame:
    """The documents of a layer added to others."""
    from .membership import merge

    return merge(membership, _layer_keys(tree, [name])[0], _layer_keys(tree, into))


def subtract_layer(membership: DataFrame, tree: ContextTree, name: str, of: list[str]) -> DataFrame:
    """The documents of a layer taken from others."""
    from .membership import subtract

    return subtract(membership, _layer_keys(tree, [name])[0], _layer_keys(tree, of))


def copy_members(membership: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Membership with the ids of each old key under its new key too."""
    spark = membership.sparkSession
    more = membership.join(spark.createDataFrame(pairs, "key string, new string"), "key").select(F.col("new").alias("key"), "doc_id")
    return membership.select("key", "doc_id").unionByName(more).distinct()


def placements(membership: DataFrame, trees: list[_Tree]) -> DataFrame:
    """doc_id, tree and path of every placement of a document."""
    spark = membership.sparkSession
    rows = [(t.key(n.layer), t.id, p) for t in trees for p, n in t.walk()]
    nodes = spark.createDataFrame(rows, "key string, tree string, path string")
    return membership.join(nodes, "key").select("doc_id", "tree", "path").distinct()


def tree_documents(membership: DataFrame, tree: _Tree, path: str | None = None, linked: bool | None = None) -> DataFrame:
    """doc_ids of a tree (or of a path with all below), linked: those also in another tree, or those in no other."""
    own = keys.normalize(f"{tree.prefix}/{tree.id}/")
    if path is None:
        ids = membership.filter(F.col("key").startswith(own)).select("doc_id").distinct()
    else:
        found = tree.keys_for(path, True) or []
        ids = membership.filter(F.col("key").isin(*found)).select("doc_id").distinct() if found else membership.select("doc_id").filter(F.lit(False))
    if linked is None:
        return ids
    placed = F.col("key").startswith("context/") | F.col("key").startswith("vfs/")
    other = membership.filter(placed & ~F.col("key").startswith(own)).select("doc_id")
    return ids.join(other, "doc_id", "left_semi" if linked else "left_anti")
