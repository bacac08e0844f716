"""Store configuration: which sources hold the dataset and its provenance."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from . import rdf


@dataclass
class Storer:
    """triplestore_urls are kept for configuration files of others; tables and files are what is read. Rows of several sources add up."""

    triplestore_urls: list[str] = field(default_factory=list)
    file_paths: list[str] = field(default_factory=list)
    is_quadstore: bool = True


#: Fixed names of the flags of text indexes; at most one may be on. They only choose a search path elsewhere; here all give one plan.
INDEXES = ("blazegraph_full_text_search", "fuseki_full_text_search", "virtuoso_full_text_search")


@dataclass
class Config:
    dataset: Storer
    provenance: Storer
    blazegraph_full_text_search: str = "no"
    fuseki_full_text_search: str = "no"
    virtuoso_full_text_search: str = "no"
    graphdb_connector_name: str = ""

    def __post_init__(self):
        on = 0
        for n in INDEXES:
            v = str(getattr(self, n)).lower()
            if v not in ("true", "1", "t", "y", "yes", "ok", "false", "0", "n", "f", "no", ""):
                raise ValueError(f"Enter a valid value for '{n}' in the configuration file, for example 'yes' or 'no'.")
            on += v in ("true", "1", "t", "y", "yes", "ok")
        if on + bool(self.graphdb_connector_name) > 1:
            raise ValueError("The use of multiple indexing systems simultaneously is currently not supported.")

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def load(cls, path: str) -> Config:
        """The configuration of a JSON file. Keys that mean nothing here, such as those of caches, are passed over."""
        with open(path) as f:
            d = json.load(f)
        storer = lambda x: Storer(**{k.name: x[k.name] for k in fields(Storer) if k.name in x})
        known = {k.name: d[k.name] for k in fields(cls) if k.name in d}
        return cls(**{**known, "dataset": storer(d["dataset"]), "provenance": storer(d["provenance"])})


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(s, p, o, g) of all files, by suffix: JSON-LD (.json, .jsonld, .zip), Parquet, and lines for the rest."""
    out = None
    for p in paths:
        rows = rdf.read_jsonld(spark, p) if p.endswith((".json", ".jsonld", ".zip")) else spark.read.parquet(p).select("s", "p", "o", "g") if p.endswith(".parquet") else rdf.read_lines(spark, p)
        out = rows if out is None else out.unionByName(rows)
    return out


def catalog(spark: SparkSession, config: Config):
    """The catalog of a configuration's files."""
    from ..functions.updates import to_ops
    from ..plans.query import Catalog

    if config.dataset.triplestore_urls or config.provenance.triplestore_urls:
        raise ValueError("Network stores are not read; give their content as files.")
    quads, more = rdf.split_provenance(read_paths(spark, config.dataset.file_paths))
    _, snaps = rdf.split_provenance(read_paths(spark, config.provenance.file_paths)) if config.provenance.file_paths else (None, more)
    return Catalog.build(quads, snaps, to_ops(snaps), config.dataset.is_quadstore)
