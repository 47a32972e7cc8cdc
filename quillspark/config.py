"""Domain profiles: validated settings with aliases."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

PAIRS = ("all_pairs", "same_sentence")
ENTRIES = ("keyword", "vector", "hybrid")


@dataclass(frozen=True)
class Chunking:
    strategy: str = "sentence"
    size: int = 512
    overlap: int = 64


@dataclass(frozen=True)
class Profile:
    name: str
    collection: str | None
    graph_label: str | None = None
    retrieval: str = "default"
    companions: tuple[str, ...] = ()
    top_k: int = 5
    entity_types: tuple[str, ...] = ()
    relation_types: tuple[str, ...] = ()
    pair_strategy: str = "all_pairs"
    chunking: Chunking = field(default_factory=Chunking)
    metadata_fields: tuple[str, ...] = ()
    entry_strategy: str = "keyword"

    def __post_init__(self) -> None:
        if self.pair_strategy not in PAIRS:
            raise ValueError(f"{self.name}: pair_strategy is one of {PAIRS}")
        if self.entry_strategy not in ENTRIES:
            raise ValueError(f"{self.name}: entry_strategy is one of {ENTRIES}")
        if self.retrieval != "dense_prose" and not (self.entity_types and self.relation_types):
            raise ValueError(f"{self.name}: entity and relation types are needed")


class Profiles:
    """Profiles by name; an alias names another, an unknown name takes the default."""

    def __init__(self, profiles: list[Profile], aliases: dict[str, str], default: str) -> None:
        self._by_name = {p.name: p for p in profiles}
        self._aliases = dict(aliases)
        self.default = default
        for a, target in aliases.items():
            if target not in self._by_name:
                raise ValueError(f"alias {a} names no profile: {target}")

    def get(self, name: str | None) -> Profile:
        name = (name or self.default).lower()
        return self._by_name.get(self._aliases.get(name, name)) or self._by_name[self.default]

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def known(self, name: str) -> bool:
        """whether a request's domain exists."""
        return name.lower() in self._by_name or name.lower() in self._aliases


def profile_of(name: str, given: Mapping) -> Profile:
    """A profile from a mapping of its settings as files have them; settings that have no effect here are passed over."""
    cut = given.get("chunking") or {}
    chunking = Chunking(cut.get("strategy", "sentence"), cut.get("chunk_size", 512), cut.get("overlap", 64))
    return Profile(
        name.lower(), given.get("collection"), given.get("neo4j_label") or given.get("graph_label"), given.get("retrieval", "dense_prose"),
        tuple(given.get("companions") or ()), given.get("top_k", 5), tuple(map(str, given.get("entity_types") or ())),
        tuple(map(str, given.get("relation_types") or ())), given.get("pair_strategy", "all_pairs"), chunking,
        tuple((given.get("metadata_schema") or {}).get("fields") or ()), given.get("entry_strategy", "keyword"),
    )


def profiles_of(given: Mapping) -> Profiles:
    """All profiles of a mapping with ``domains`` and ``default_domain``. A domain that has ``alias`` is another name
    of the domain it says. Without a default the first domain is it."""
    domains = {str(n).lower(): d or {} for n, d in (given.get("domains") or {}).items()}
    profiles = [profile_of(n, d) for n, d in domains.items() if "alias" not in d]
    if not profiles:
        raise ValueError("no domains")
    aliases = {n: str(d["alias"]).lower() for n, d in domains.items() if "alias" in d}
    return Profiles(profiles, aliases, str(given.get("default_domain") or profiles[0].name).lower())


def load_profiles(spark: SparkSession, path: str) -> Profiles:
    """Profiles from a file that Spark reads: JSON, or YAML where a parser is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("no YAML parser is installed; give the profiles as JSON") from e
        return profiles_of(yaml.safe_load(text))
    return profiles_of(json.loads(text))
