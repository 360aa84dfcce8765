"""Configuration of the provenance engine: what the PROV data model fixes, and choices of ours."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the W3C PROV data model and of the corpora: sections, relation
# fields in order, keys that vary from record to record, files that are not documents.
NODE_SECTIONS = ("entity", "activity", "agent")
REL_SCHEMA: dict[str, tuple[str, ...]] = {
    "used": ("prov:activity", "prov:entity", "prov:role", "prov:time"),
    "wasGeneratedBy": ("prov:entity", "prov:activity", "prov:role", "prov:time"),
    "wasAssociatedWith": ("prov:activity", "prov:agent", "prov:plan", "prov:role"),
    "wasInformedBy": ("prov:informed", "prov:informant"),
    "wasAttributedTo": ("prov:entity", "prov:agent", "prov:role"),
    "wasDerivedFrom": ("prov:generatedEntity", "prov:usedEntity", "prov:activity", "prov:generation", "prov:usage"),
    "actedOnBehalfOf": ("prov:delegate", "prov:responsible", "prov:activity"),
    "wasStartedBy": ("prov:activity", "prov:trigger", "prov:starter", "prov:time"),
    "wasEndedBy": ("prov:activity", "prov:trigger", "prov:ender", "prov:time"),
    "wasInvalidatedBy": ("prov:entity", "prov:activity", "prov:role", "prov:time"),
    "wasInfluencedBy": ("prov:influencee", "prov:influencer"),
    "specializationOf": ("prov:specificEntity", "prov:generalEntity"),
    "alternateOf": ("prov:alternate1", "prov:alternate2"),
    "hadMember": ("prov:collection", "prov:entity"),
    "mentionOf": ("prov:specificEntity", "prov:generalEntity", "prov:bundle"),
}
VOLATILE_ATTR_KEYS = frozenset({
    "prov:label", "prov:location", "checksum:sha256", "model:path", "pred:rows", "pred:folds",
    "split:size_bytes", "pred:size_bytes", "model:size_bytes", "openml:task_id", "flowparams:sha256",
    "prov:value", "prov:generatedAtTime", "prov:startTime", "prov:endTime", "prov:atTime",
})
IGNORED_ATTR_KEYS = VOLATILE_ATTR_KEYS
SIDECAR_NAMES = frozenset({"manifest.json", "checksums.sha256", "corpus_manifest.json", "conformance_report.json"})
SIDECAR_SUFFIX = ".transcript.json"
# End of fixed values.

ID_ORDERS = ("lexical", "frequency", "first_seen")


@dataclass(frozen=True)
class ProvConfig:
    """What the operators need to know; replace a field to change it."""

    node_sections: tuple[str, ...] = NODE_SECTIONS
    rel_schema: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REL_SCHEMA))
    volatile_keys: frozenset[str] = VOLATILE_ATTR_KEYS
    id_order: str = "first_seen"

    def __post_init__(self) -> None:
        if self.id_order not in ID_ORDERS:
            raise ValueError(f"id_order must be one of {ID_ORDERS}")

    def __hash__(self) -> int:
        return hash((self.node_sections, tuple(self.rel_schema.items()), self.volatile_keys, self.id_order))


DEFAULT = ProvConfig()
