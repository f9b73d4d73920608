"""A store in versions: hash-bucketed folders behind one manifest, which is swapped last.

A relation's rows lie in folders by bucket, a hash of their key.  A manifest names the folders of every relation; the one of
the highest number is the store.  A transaction writes new folders beside the old ones and then renames one manifest into place, which
fails if that number is taken.  So a write is seen as a whole or not at all, whatever it touches and wherever it is cut off;
readers keep the version that they resolved, and of two writers that began from one version the second is refused.

Replacing subjects reads and rewrites the buckets of their keys only; inserts read the buckets of the new rows and write the
new rows.  A bucket's rows go to as many as ``spread`` files by a hash of the whole row, so a hot key has no task of its own.
Folders that no manifest names any more go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena import contracts as C
from verbena.operators import graph, store

#: The columns by which a relation is dealt into buckets.
KEYS = {
    "nodes": ("node_id",), "aliases": ("node_id",), "alias_index": ("node_id",), "edges": ("from_id",), "entailed_edges": ("from_id",),
    "mentions": ("node_id",), "judgments": ("subject_id",), "embeddings": store.SUBJECT, "token_embeddings": store.SUBJECT,
}


def _ddl(relation: str) -> str:
    if relation == "alias_index":
        return f"{_ddl('aliases')}, normalized_alias STRING, token_count INT"
    return graph.SCHEMAS[relation].replace("! ", " ")


class Store:
    """A store below ``root``, a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, spread: int = 4):
        self.spark, self.root, self.buckets, self.spread = spark, root.rstrip("/"), buckets, spread
        self._jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = self._path("")
        self._fs = path.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        path = self._path(below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """{"version", "buckets", "relations": {relation: {bucket: [folder]}}} of a version, the last if none is given."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "buckets": self.buckets, "relations": {}}
        version = known[-1] if version is None else version
        if version not in known:
            raise C.ContractError(f"the store has no version {version}")
        text = self.spark.read.text(f"{self.root}/manifests/{version:010}.json", wholetext=True).first()[0]
        return json.loads(text)

    def table(self, relation: str, version: int | None = None) -> DataFrame:
        """A relation as of a version; what is written later does not change it."""
        return self._read(self.manifest(version), relation)

    def views(self, prefix: str = "semantic") -> None:
        """Temporary views ``prefix_relation`` over the last version."""
        manifest = self.manifest()
        for relation in KEYS:
            self._read(manifest, relation).createOrReplaceTempView(f"{C.identifier(prefix)}_{relation}")

    def _read(self, manifest: dict, relation: str, buckets: list[int] | None = None) -> DataFrame:
        named = manifest["relations"].get(relation, {})
        folders = [f"{self.root}/{f}" for b, fs in named.items() if buckets is None or int(b) in buckets for f in fs]
        schema = T.StructType.fromDDL(_ddl(relation))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, relation: str, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(*KEYS[relation]), F.lit(manifest["buckets"])).cast("int")

    def _touched(self, relation: str, manifest: dict, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self._bucket(relation, manifest)).distinct().collect()]

    def _write(self, relation: str, manifest: dict, rows: DataFrame) -> dict[str, list[str]]:
        """Rows in a new folder; its folders by bucket."""
        folder = f"data/{relation}/{uuid.uuid4().hex}"
        names = [f.name for f in T.StructType.fromDDL(_ddl(relation))]
        x = rows.select(*names).withColumn("bucket", self._bucket(relation, manifest))
        salt = F.pmod(F.xxhash64(*names), F.lit(self.spread))
        x.repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return {n.removeprefix("bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("bucket=")}

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        """Writes that become one version when the block ends, and none if it raises."""
        t = Transaction(self)
        yield t
        t.commit()

    def _commit(self, manifest: dict) -> int:
        version = manifest["version"] + 1
        manifest = manifest | {"version": version}
        part, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:010}.json")
        out = self._fs.create(part, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._context.rename(self._fs.makeQualified(part), self._fs.makeQualified(name), how)
        except Exception as e:
            self._fs.delete(part, False)
            if self._fs.exists(name):
                raise C.ContractError(f"version {version} was written by someone else; nothing was changed") from e
            raise
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` manifests and every folder that none of them names; returns the folders.

        To be run while no transaction is open, since those write folders that no manifest names yet.
        """
        last = self.versions()[-max(1, keep) :]
        used = {f for v in last for named in self.manifest(v)["relations"].values() for fs in named.values() for f in fs}
        for v in self.versions():
            if v not in last:
                self._fs.delete(self._path(f"manifests/{v:010}.json"), False)
        written = [f"data/{r}/{n}" for r in self._names("data") for n in self._names(f"data/{r}")]
        gone = [f for w in written for n in self._names(w) if n.startswith("bucket=") and (f := f"{w}/{n}") not in used]
        for f in gone:
            self._fs.delete(self._path(f), True)
        return gone

    # --- the writes of ``store``, each one transaction

    def write_graph(self, nodes: DataFrame | None = None, aliases: DataFrame | None = None, edges: DataFrame | None = None, replace: bool = False, index: bool = True) -> int:
        """Adds rows that are absent; with ``replace``, the supplied relations' former rows go.  Returns the new version."""
        given = {k: graph.conform(v, k) for k, v in (("nodes", nodes), ("aliases", aliases), ("edges", edges)) if v is not None}
        with self.transaction() as t:
            for relation, rows in given.items():
                if replace:
                    t.put(relation, rows)
                else:
                    t.insert_absent(relation, rows, "node_id" if relation == "nodes" else None)
            if index and "aliases" in given:
                t.put("alias_index", graph.alias_index(t.table("aliases")))
        return t.version

    def write_embeddings(self, rows: DataFrame, replace: bool = False) -> int:
        return self._vectors("embeddings", store.checked_vectors(rows, "embeddings"), replace)

    def write_token_embeddings(self, rows: DataFrame, replace: bool = False) -> int:
        return self._vectors("token_embeddings", store.checked_tokens(rows), replace)

    def _vectors(self, relation: str, rows: DataFrame, replace: bool) -> int:
        with self.transaction() as t:
            (t.replace if replace else t.append)(relation, rows)
        return t.version

    def record(self, rows: DataFrame, relation: str) -> int:
        """Appends validated mentions or judgments."""
        with self.transaction() as t:
            t.append(relation, graph.conform(store.timed(rows, relation), relation))
        return t.version


class Transaction:
    """Changes against one version of a store.  ``table`` shows them before they are committed."""

    def __init__(self, of: Store):
        self.of, self.manifest, self.version = of, of.manifest(), None

    def table(self, relation: str) -> DataFrame:
        return self.of._read(self.manifest, relation)

    def _set(self, relation: str, change: Callable[[dict], dict]) -> None:
        relations = self.manifest["relations"]
        self.manifest = self.manifest | {"relations": relations | {relation: change(relations.get(relation, {}))}}

    def append(self, relation: str, rows: DataFrame) -> None:
        new = self.of._write(relation, self.manifest, rows)
        self._set(relation, lambda old: old | {b: old.get(b, []) + fs for b, fs in new.items()})

    def put(self, relation: str, rows: DataFrame) -> None:
        """Rows in place of the whole relation."""
        new = self.of._write(relation, self.manifest, rows)
        self._set(relation, lambda _: new)

    def insert_absent(self, relation: str, rows: DataFrame, unique: str | None = None) -> None:
        """Rows that the relation lacks, each once; null equals null.  Only buckets of the new rows are read."""
        stored = self.of._read(self.manifest, relation, self.of._touched(relation, self.manifest, rows))
        new = store.absent(stored, rows)
        if unique:
            C.unique(stored.unionByName(new), [unique], relation)
        self.append(relation, new)

    def replace(self, relation: str, rows: DataFrame) -> None:
        """Rows in place of all former rows of their keys.  Only buckets of those keys are read and written anew."""
        touched = self.of._touched(relation, self.manifest, rows)
        kept = graph.replace_by(self.of._read(self.manifest, relation, touched), rows.select(*(f.name for f in T.StructType.fromDDL(_ddl(relation)))), list(KEYS[relation]))
        new = self.of._write(relation, self.manifest, kept)
        self._set(relation, lambda old: {b: fs for b, fs in old.items() if int(b) not in touched} | new)

    def commit(self) -> int:
        self.version = self.of._commit(self.manifest)
        return self.version
