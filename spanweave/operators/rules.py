"""The highlight rules as data: each names the spans that it rejects, in SQL over the feature columns.

Features: n (pulses), d (length), rho (pulses a unit), iso and nx (distance to the pulse before and after; 99: none), fi and li (first and last
distance inside; 0 for one pulse), lo_isi and hi_isi (least and greatest), ac (active share between first and last pulse), pre (the same
in the units 2.2 to 0.5 before), burst, nin (pulses in court), mean_e and p85 (energy), motion (any sample there), first_at and
last_at, start_at (time in the stream), tail_span (last minus second pulse), mid_isi (any distance in [1.45, 1.80]), peeled.
Rules apply in order; the first that holds is the reason.
"""

from __future__ import annotations

# The default profile of the highlight filter.
DEFAULTS = {"min_duration": 1.5, "max_duration": 22.0, "min_hits": 2, "min_density": 0.22}
# The on-device profile.
DEVICE = {"min_duration": 1.2, "max_duration": 22.0, "min_hits": 2, "min_density": 0.18}

SERVE_LIKE = "(iso >= 1.85 AND CASE WHEN n = 1 THEN (iso BETWEEN 9 AND 30 AND d BETWEEN 1.2 AND 6.8) OR (iso BETWEEN 3.2 AND 30 AND d BETWEEN 1.2 AND 3.8) ELSE fi BETWEEN 0.22 AND 2.55 END)"
COMPACT_THREE = "(n = 3 AND d BETWEEN 2 AND 7 AND iso BETWEEN 1.65 AND 2.50 AND fi BETWEEN 0.40 AND 0.80 AND li BETWEEN 1.45 AND 2.00 AND nx >= 3.20)"
WALK_IN = "(start_at <= 0.40 AND first_at <= 0.85 AND last_at <= 5.5 AND d <= 6.0 AND n >= 4)"
FAR_ONE = f"(n = 1 AND {SERVE_LIKE} AND ((burst AND nx >= 3.2) OR (iso >= 9 AND nx BETWEEN 1.8 AND 3.5) OR (iso >= 3.3 AND iso < 5 AND nx >= 3.6)))"
SILENT_ONE = "(n = 1 AND burst AND iso >= 1.05 AND iso < 2.50 AND nx >= 5.2 AND d <= 5.5)"
#: The compact shape counts only without a burst.
QUIET_THREE = f"(NOT burst AND {COMPACT_THREE})"


def rules(min_duration: float, max_duration: float, min_hits: int, min_density: float) -> dict[str, str]:
    """The conditions and constants of the rules."""
    always = {
        "R1": f"d < {min_duration}",
        "R2": f"d > {min(max_duration + 2, 16.8)}",
        "R3": WALK_IN,
        "R4": f"n < {min_hits} AND NOT ({min_hits <= 2} AND ({FAR_ONE} OR {SILENT_ONE}))",
        "R5": f"n >= 2 AND rho < {min_density} AND n < {min_hits + 2} AND NOT (n <= 2 AND d <= 5.5)",
        "R6": f"d >= 12 AND rho < {0.85 * min_density!r}",
        "R7": "d >= 6 AND rho > 1.7 AND n >= 10 AND NOT peeled",
        "R8": f"n <= 3 AND NOT burst AND NOT {SERVE_LIKE} AND NOT {QUIET_THREE}",
        "R9": "n = 2 AND NOT burst AND fi > 1.6",
        "R10": "n >= 4 AND NOT burst AND motion",
        "R11": f"n BETWEEN 2 AND 3 AND NOT burst AND d >= 2.45 AND motion AND NOT {QUIET_THREE} AND ac < 0.12",
        "R12": f"n = 2 AND NOT burst AND motion AND nx < 3.2 AND NOT {QUIET_THREE} AND nin = 0",
        "R13": "d BETWEEN 6 AND 9.5 AND n >= 7 AND iso < 2.30",
        "R14": "d BETWEEN 8 AND 11 AND n BETWEEN 4 AND 6 AND iso < 1.85",
        "R15": "n >= 11 AND d >= 10 AND iso < 2.15",
    }
    with_motion = {
        "R16": "d >= 2.5 AND ac < 0.12 AND n >= 4",
        "R17": f"d >= 3 AND ac < 0.18 AND rho < {1.15 * min_density!r} AND n >= 4",
        "R18": "d <= 5 AND ac < 0.12 AND n >= 5",
        "R19": "d >= 12 AND n >= 15 AND p85 > 0.00001 AND mean_e >= 0.80 * p85",
        "R20": "d >= 8.5 AND n >= 8 AND fi >= 2.0 AND p85 > 0.00001 AND mean_e >= 0.80 * p85",
        "R21": "first_at >= 8 AND d >= 8 AND n >= 8 AND fi < 4.5 AND pre >= 0.55 AND iso < 5.5",
        "R22": "first_at >= 8 AND d >= 8 AND n >= 6 AND fi < 4.5 AND pre >= 0.58 AND iso < 2.4",
        "R23": "first_at >= 8 AND d >= 4.5 AND n >= 5 AND pre >= 0.55 AND iso < 2.05 AND fi < 4.5",
        "R24": "first_at >= 8 AND d >= 5.8 AND n BETWEEN 4 AND 6 AND pre >= 0.70 AND iso < 5.0",
        "R25": "first_at >= 8 AND n = 2 AND d <= 4.5 AND pre >= 0.42 AND iso < 4.0 AND fi > 0.55",
        "R26": "first_at >= 8 AND n = 2 AND d <= 2.3 AND pre >= 0.60 AND iso >= 1.85 AND iso < 2.80 AND fi <= 0.55",
        "R27": "n = 4 AND d BETWEEN 4.2 AND 5.8 AND lo_isi >= 0.90 AND hi_isi <= 1.75",
        "R28": "n = 5 AND d <= 5.3 AND fi >= 1.55 AND tail_span <= 1.50 AND ac < 0.30",
        "R29": "n = 4 AND d <= 4.6 AND li <= 0.40 AND mid_isi",
        "R30": "n = 5 AND d <= 4.5 AND rho >= 2.2 AND hi_isi <= 0.65 AND nx < 2.5 AND ac >= 0.80",
        "R31": "n = 6 AND d <= 5.5 AND rho >= 1.85 AND hi_isi <= 0.90 AND nin <= 3",
        "R32": "n = 3 AND d BETWEEN 4.5 AND 6 AND fi BETWEEN 2.0 AND 2.8 AND li <= 0.70 AND pre >= 0.55 AND ac >= 0.65",
        "R33": "n = 3 AND d <= 2.8 AND fi <= 0.35 AND li <= 0.65 AND iso >= 3.5 AND nx < 3.0 AND pre >= 0.85 AND burst",
    }
    return always | {k: f"motion AND {v}" for k, v in with_motion.items()}


def reject_rule(**profile: float) -> str:
    """One CASE: the first rule that rejects a span, or null for a highlight."""
    branches = " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules(**(DEFAULTS | profile)).items())
    return f"CASE {branches} END"
