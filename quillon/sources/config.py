"""Network settings and the parameter tables that go with them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters of the node classes (ms, mV, nF, MOhm) and of their synapses.
NODE_PARAMETERS = {
    "ORN": dict(tau_m=20.0, tau_ref=2.0, v_rest=-65.0, v_thresh=-50.0, v_reset=-70.0, cm=0.2, r_m=100.0),
    "LN": dict(tau_m=15.0, tau_ref=1.5, v_rest=-60.0, v_thresh=-45.0, v_reset=-65.0, cm=0.15, r_m=80.0),
    "PN": dict(tau_m=25.0, tau_ref=2.0, v_rest=-65.0, v_thresh=-48.0, v_reset=-68.0, cm=0.25, r_m=120.0),
}
SYNAPSES = {
    "LN": dict(transmitter="GABA", e_rev=-80.0, tau=10.0, delay=0.5, effect="inhibitory"),
    "ORN": dict(transmitter="ACh", e_rev=0.0, tau=5.0, delay=2.0, effect="excitatory"),
    "PN": dict(transmitter="ACh", e_rev=0.0, tau=5.0, delay=2.0, effect="excitatory"),
}


@dataclass(frozen=True)
class NetworkConfig:
    min_synapses: int = 1
    max_synapses: int | None = None
    lateral: bool = True
    inhibitory_to_relay: bool = True
    relay: bool = True
    weight_scale: float = 0.1
    duration: float = 1000.0
    dt: float = 0.1
    hub_percentile: float = 90.0
    community_method: str = "louvain"
    layout: str = "spring"
    seed: int = 42
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.min_synapses < 1:
            raise ValueError("min_synapses is 1 or more")
        if self.max_synapses is not None and self.max_synapses < self.min_synapses:
            raise ValueError("max_synapses is min_synapses or more")

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> NetworkConfig:
        """Settings given override the defaults; unknown ones are kept in `extra`."""
        given = json.loads(text)
        extra = given.pop("extra", {})
        known = set(cls.__dataclass_fields__)
        return cls(**{k: v for k, v in given.items() if k in known}, extra=extra | {k: v for k, v in given.items() if k not in known})


PRESETS = {
    "default": NetworkConfig(),
    "strong": NetworkConfig(min_synapses=10),
    "lateral_only": NetworkConfig(inhibitory_to_relay=False, relay=False),
    "feed_forward": NetworkConfig(lateral=False, inhibitory_to_relay=False),
}


def synapse(kind: str) -> dict:
    """Synapse of a presynaptic class; unknown classes are an error."""
    if kind not in SYNAPSES:
        raise ValueError(f"unknown class {kind!r}; one of {', '.join(SYNAPSES)}")
    return SYNAPSES[kind]


def parameters(spark: SparkSession) -> DataFrame:
    """(class, parameters..., transmitter, e_rev, tau, delay, effect)"""
    rows = [F.struct(F.lit(k).alias("class"), *[F.lit(v).alias(n) for n, v in (NODE_PARAMETERS[k] | SYNAPSES[k]).items()]) for k in NODE_PARAMETERS]
    return spark.range(1).select(F.inline(F.array(*rows)))
