"""Blocking experiments as data: which channels to block for a pathway, and what to expect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import predict, response

# What each numbered protocol tests, and the settings of its steps.
KNOWN = {
    1: {
        "title": "One cell's veto", "pathway": "or47b_feeding", "claim": "Silencing one cell of the channel is enough to stop the response to 1-hexanol.", "weeks": 2, "difficulty": "high",
        "steps": (
            ("Find the channel's cells by their labels", {"receptor": "Or47b", "sensillum_type": "ab1A"}), ("Express a light-gated silencer in them", {"driver": "Or47b-GAL4", "effector": "UAS-GtACR1", "wavelength": "470nm"}),
            ("Give the odour and film the proboscis", {"odorant": "1-hexanol", "concentration": "10^-3 dilution", "duration": "2s"}), ("Silence one cell around the odour's onset", {"light_intensity": "1 mW/mm^2", "duration": "5s", "timing": "1s before odor onset"}),
            ("Test the loss of the response", {"n_flies": 30, "trials_per_fly": 10, "statistics": "paired t-test"}),
        ),
        "controls": ("driver without silencer", "silencer without light", "light on cells of other channels", "another odour"),
    },
    2: {
        "title": "Removal of the channel", "pathway": "or47b_feeding", "claim": "Without the channel's cells the attraction to 1-hexanol is gone, and that to other odours is not.", "weeks": 4, "difficulty": "medium",
        "steps": (
            ("Measure the preference before", {"odorant": "1-hexanol", "concentration": "10^-3", "n_flies": 50}), ("Remove the channel's cells", {"method": "UAS-reaper", "driver": "Or47b-GAL4", "timing": "developmental"}),
            ("Measure the preference after", {"odorant": "1-hexanol", "concentration": "10^-3", "n_flies": 50}), ("Measure it for other odours", {"odorants": ["ethyl acetate", "acetic acid", "apple cider vinegar"], "n_odorants": 10}),
        ),
        "controls": ("removal of another channel's cells", "driver without effector", "injury without removal"),
    },
    3: {
        "title": "Synapses before and after learning", "pathway": "or47b_feeding", "claim": "Pairing the odour with a reward changes the channel's synapses in its region.", "weeks": 6, "difficulty": "very high",
        "steps": (
            ("Mark both sides of the synapses", {"presynaptic": "Or47b-GAL4 > UAS-syt-GFP", "postsynaptic": "GH146-LexA > LexAop-mCherry"}), ("Image them before", {"imaging_depth": "50-100μm", "resolution": "0.5μm/pixel", "time_series": "before conditioning"}),
            ("Pair odour and reward", {"odorant": "1-hexanol", "reward": "2M sucrose", "trials": 10, "inter_trial_interval": "5min"}), ("Image the same cells after", {"timing": "2h and 24h after conditioning", "same_neurons": True}),
            ("Compare the counts", {"n_flies": 15, "n_glomeruli": "bilateral DM1", "statistics": "repeated-measures ANOVA"}),
        ),
        "controls": ("odour and reward unpaired", "pairing with another odour", "images without pairing"),
    },
    6: {
        "title": "Map of causal channels", "pathway": "or47b_feeding", "claim": "Each behaviour depends on few channels.", "weeks": 12, "difficulty": "high", "ranked": 20,
        "steps": (
            ("Build a silencing line for each ranked channel", {"effector": "UAS-Kir2.1 (silencer)"}), ("Screen the lines' behaviour", {"odorants": ["hexanol", "ethyl butyrate", "acetic acid"], "n_flies_per_line": 30, "behaviors": ["attraction", "avoidance", "feeding"]}),
            ("Keep the channels whose block matters", {"threshold": "50% reduction", "significance": "p < 0.01, Bonferroni corrected"}), ("Draw channels and behaviours as a graph", {"nodes": "receptors + behaviors", "edges": "causal blocking relationships", "weights": "blocking strength"}),
        ),
        "controls": ("empty driver for each line", "a marker in place of the silencer", "flies without either"),
    },
}

#: Steps and controls of a protocol for channels of one's own.
OWN_STEPS = (("Set the intervention up", {}), ("Test the behaviour", {"n_flies": 30, "trials": 10}))
OWN_CONTROLS = ("empty vector", "no intervention")


def _steps(steps, targets: list[str]) -> list[dict]:
    return [{"number": i, "action": action, "target": ", ".join(targets), "parameters": dict(parameters)} for i, (action, parameters) in enumerate(steps, 1)]


def protocol(table: DataFrame, pathways: DataFrame, name: str, steps=OWN_STEPS, controls=OWN_CONTROLS) -> dict:
    """A protocol for a pathway (pathway, channel, item): its strength, critical channels, steps and controls."""
    own = pathways.filter(F.col("pathway") == name)
    strength = response.pathway_strength(table, own).first()
    if strength is None:
        raise ValueError(f"unknown pathway {name!r}")
    cells = table.join(own, ["channel", "item"]).select("channel", "item", "response")
    targets = response.critical(response.contributions(cells)).orderBy(F.desc("contribution"), "channel").collect()
    drops = [{"channel": r.channel, "expected_drop": r.contribution} for r in targets]
    return {"pathway": name, "strength": strength.strength, "targets": drops, "steps": _steps(steps, [t["channel"] for t in drops]), "controls": list(controls)}


def known_protocol(table: DataFrame, number: int) -> dict:
    """One of the numbered protocols, with the pathway's strength and targets in this table; number 6 ranks the table's channels by importance."""
    if number not in KNOWN:
        raise ValueError(f"unknown protocol {number}; one of {', '.join(map(str, KNOWN))}")
    k = KNOWN[number]
    p = protocol(table, predict.pathway_table(table.sparkSession), k["pathway"], k["steps"], k["controls"])
    if "ranked" in k:
        ranked = response.importance(table).orderBy(F.desc_nulls_last("importance"), "channel").limit(k["ranked"])
        own = [r.channel for r in ranked.select("channel").collect()]
        p["steps"][0] |= {"target": ", ".join(map(str, own)), "parameters": {"receptors": own} | p["steps"][0]["parameters"]}
        p |= {"conditions": len(own) * len(p["steps"][1]["parameters"]["odorants"])}
    return {"number": number, "title": k["title"], "claim": k["claim"], "weeks": k["weeks"], "difficulty": k["difficulty"]} | p


def own_protocol(title: str, claim: str, channels: list[str], intervention: str = "optogenetic silencing") -> dict:
    """A protocol for channels of one's own choice."""
    steps = _steps(OWN_STEPS, list(channels))
    steps[0]["parameters"] = {"receptors": list(channels), "method": intervention}
    return {"title": title, "claim": claim, "targets": [{"channel": c, "expected_drop": None} for c in channels], "steps": steps, "controls": list(OWN_CONTROLS)}


def to_json(p: dict) -> str:
    return json.dumps(p, indent=2)


def to_markdown(p: dict) -> str:
    lines = [f"# {p['title']}" if "title" in p else f"# Blocking {p['pathway']}", "", *([p["claim"], ""] if "claim" in p else []), *([f"Strength: {p['strength']:.3f}", ""] if "strength" in p else []), "## Targets"]
    lines += [f"- {t['channel']}" + ("" if t["expected_drop"] is None else f": {t['expected_drop']:.1%}") for t in p["targets"]]
    lines += ["", "## Steps"]
    for x in p["steps"]:
        lines += [f"{x['number']}. {x['action']} ({x['target']})", *[f"   - {k.replace('_', ' ')}: {', '.join(map(str, v)) if isinstance(v, list) else v}" for k, v in x["parameters"].items()]]
    return "\n".join([*lines, "", "## Controls", *[f"- {c}" for c in p["controls"]]]) + "\n"
