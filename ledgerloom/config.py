"""Every constant of the analysis, in one frozen object that travels with a plan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


#: What counts as dust of each asset.
DUST = {
    "ETH": 0.01,
    "WETH": 0.01,
    "POL": 1.0,
    "BNB": 0.002,
    "USDT": 1.0,
    "USDC": 1.0,
    "USDC.E": 1.0,
    "DAI": 1.0,
    "WBTC": 0.00002,
    "BTCB": 0.00002,
}

#: Chains by id, with the name labels use and the native asset.
CHAINS = {
    1: ("ethereum", "Ethereum", "ETH"),
    137: ("polygon", "Polygon", "POL"),
    56: ("bnb", "BNB Chain", "BNB"),
    42161: ("arbitrum", "Arbitrum One", "ETH"),
}


def chain(chain_id: int | None = None) -> tuple[str, str, str]:
    """The chain's slug, name and native asset; the first one's if no id is given."""
    found = CHAINS.get(1 if chain_id is None else int(chain_id))
    if found is None:
        raise ValueError(f"unknown chain {chain_id}; known: " + ", ".join(f"{i} ({c[1]})" for i, c in CHAINS.items()))
    return found


@dataclass(frozen=True)
class EngineConfig:
    # walk
    max_depth: int = 4
    max_edges: int = 25
    max_wallets: int | None = 400
    history_rows: int | None = 1000
    chain: str = "ethereum"
    # dust, by symbol; a request's own limit holds for native assets alone
    dust_native: float = 0.01
    dust: dict[str, float] = field(default_factory=lambda: dict(DUST))
    dust_default: float = 1.0
    native: tuple[str, ...] = ("ETH", "POL", "BNB")
    # identification
    label_confidence: float = 0.95
    fan_in_min: int = 4
    fan_in_flag: int = 6
    fan_in_strong: int = 12
    consolidation_max: float = 0.70
    fan_in_quantile: float = 0.95
    # scoring
    points_label: int = 50
    points_consolidation: int = 22
    points_other: int = 10
    points_hop: int = 30
    points_per_hop: int = 7
    points_clean: int = 15
    points_mixer: int = -30
    points_bridge: int = -12
    score_low: int = 5
    score_high: int = 95
    # typologies
    peel_links: int = 3
    peel_dominant: float = 0.80
    peel_side: float = 0.20
    peel_growth: float = 1.05
    layer_links: int = 3
    dwell_low: int = 1
    dwell_high: int = 3600
    layer_ratio: tuple[float, float] = (0.95, 1.25)
    structure_parties: int = 6
    structure_cv: float = 0.10
    pass_ratio: tuple[float, float] = (0.90, 1.25)
    round_digits: int = 2
    round_count: int = 3
    round_share: float = 0.60
    material_factor: float = 100.0
    reported: int = 15
    strength_cap: int = 90
    terminal: tuple[str, ...] = ("exchange", "suspected_exchange", "mixer", "bridge")

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)


#: Severity of an entity type met on the way.
SEVERITY = {"sanctioned": "critical", "scam": "critical", "mixer": "high", "bridge": "medium"}
