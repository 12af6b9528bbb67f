"""The whole highlight filter over one recording: split, anchor, trim, merge again, peel, judge, dedupe.

Its steps feed bounds back into each other (a merge decides on merged bounds), so a stream is folded as a unit in Arrow-batched
Python; a stream is one recording, with spans and pulses in the thousands at most.  The judging rules are those of ``rules``: the same SQL text,
evaluated here by SQLite.  Times are seconds.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rules

FAR = 99.0  # the distance to a pulse that is not there
SLACK = 0.05  # both ends of every look-up of pulses


@dataclass(frozen=True)
class Profile:
    """Pads, silences and limits of the default profile."""

    serve_pad: float = 1.05
    land_pad: float = 0.60
    silence: float = 1.85
    bridge: float = 4.2
    remerge_gap: float = 1.15
    min_hits: int = 2
    min_duration: float = 1.5
    max_duration: float = 22.0
    min_density: float = 0.22

    def rule(self) -> str:
        return rules.reject_rule(min_duration=self.min_duration, max_duration=self.max_duration, min_hits=self.min_hits, min_density=self.min_density)


DEVICE = Profile(land_pad=0.70, silence=2.45, min_duration=1.2, min_density=0.18, remerge_gap=1.30)


@dataclass(frozen=True)
class Span:
    start: float
    end: float
    first: float
    last: float
    confidence: float = 0.8
    peeled: bool = False

    @property
    def duration(self) -> float:
        return self.end - self.start


class Hits:
    def __init__(self, t) -> None:
        self.t = np.sort(np.asarray(t, float))

    def within(self, a: float, b: float) -> np.ndarray:
        return self.t[np.searchsorted(self.t, a - SLACK, "left") : np.searchsorted(self.t, b + SLACK, "right")]

    def before(self, x: float) -> float:
        """The last pulse well before ``x``, or minus infinity."""
        k = np.searchsorted(self.t, x - 0.12, "left")
        return float(self.t[k - 1]) if k else -np.inf

    def isolation(self, x: float) -> float:
        b = self.before(x)
        return x - b if np.isfinite(b) else FAR

    def gap_after(self, x: float) -> float:
        k = np.searchsorted(self.t, x + 0.12, "right")
        return float(self.t[k] - x) if k < len(self.t) else FAR


class Motion:
    def __init__(self, t, e) -> None:
        self.t, self.e = np.asarray(t, float), np.asarray(e, float)
        self.any = len(self.t) > 0
        self.base = float(np.median(self.e)) if self.any else 0.0
        self.p85 = float(np.percentile(self.e, 85)) if self.any else 0.0
        self.spread = max(0.0, self.p85 - self.base)

    def level(self, share: float, least: float) -> float:
        return max(least, self.base + share * self.spread)

    def part(self, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        s = slice(np.searchsorted(self.t, a, "left"), np.searchsorted(self.t, b, "right"))
        return self.t[s], self.e[s]

    def active(self, a: float, b: float) -> float:
        """Share of active samples; a flat series that is high all along counts as active."""
        _, e = self.part(a, b)
        if not len(e):
            return 0.0
        if self.p85 - self.base < 1e-5:
            if self.base >= 0.012 and e.mean() >= 0.85 * self.base:
                return 1.0
            return float((e >= max(self.base + 0.004, 0.012)).mean())
        return float((e >= self.level(0.14, 0.008)).mean())

    def burst(self, a: float, b: float) -> bool:
        """A peak, or three samples in a row over a lower level."""
        _, e = self.part(a, b)
        if not len(e):
            return False
        hot = e >= self.level(0.28, 0.014)
        return bool(e.max() >= self.level(0.40, 0.016)) or bool((hot[:-2] & hot[1:-1] & hot[2:]).any())

    def in_court(self, x: float) -> bool:
        _, e = self.part(x - 0.40, x + 0.40)
        if not len(e):
            if not self.any:
                return False
            e = self.e[[int(np.argmin(np.abs(self.t - x)))]]
        return bool(e.max() >= self.level(0.10, 0.008))

    def run(self, levels: np.ndarray, quiet: int) -> int:
        """How far from the front a run of active samples reaches that bears ``quiet`` quiet ones: the index of its last active sample."""
        at = np.flatnonzero(levels)
        stop = np.flatnonzero(np.diff(at) > quiet + 1)
        return int(at[stop[0]] if len(stop) else at[-1])


@dataclass
class HighlightFilter:
    hits: Hits
    motion: Motion
    p: Profile = field(default_factory=Profile)

    def __post_init__(self) -> None:
        self._sql = sqlite3.connect(":memory:")

    # --- shapes ---
    def features(self, s: Span) -> dict:
        t = self.hits.within(s.first, s.last)
        n, isi, m = len(t), np.diff(t), self.motion
        wide = s.last - s.first >= 0.4
        inside = m.part(s.first, s.last)[1]
        return {
            "n": n, "d": s.duration, "rho": n / max(0.25, s.last - s.first), "iso": self.hits.isolation(s.first), "nx": self.hits.gap_after(s.last), "fi": isi[0] if n > 1 else 0.0, "li": isi[-1] if n > 1 else 0.0,
            "lo_isi": isi.min() if n > 1 else 0.0, "hi_isi": isi.max() if n > 1 else 0.0, "tail_span": t[-1] - t[1] if n > 1 else 0.0, "mid_isi": bool(((isi >= 1.45) & (isi <= 1.80)).any()),
            "ac": m.active(s.first, s.last), "pre": m.active(max(0.0, s.first - 2.2), max(0.0, s.first - 0.5)), "burst": m.burst(s.first - (0 if wide else 0.4), s.last + (0 if wide else 0.4)), "nin": sum(m.in_court(x) for x in t),
            "mean_e": inside.mean() if len(inside) else 0.0, "p85": m.p85, "motion": m.any, "first_at": s.first, "last_at": s.last, "start_at": s.start, "peeled": s.peeled,
        }

    def _test(self, condition: str, f: dict):
        names = ", ".join(f":{k} AS {k}" for k in f)
        values = {k: int(v) if isinstance(v, (bool, np.bool_, int)) else float(v) for k, v in f.items()}
        return self._sql.execute(f"SELECT {condition} FROM (SELECT {names})", values).fetchone()[0]

    def reject_rule(self, s: Span) -> str | None:
        return self._test(self.p.rule(), self.features(s))

    def live(self, a: float, b: float) -> bool:
        """Whether a hole between pulses is play: short enough, or bridged by motion."""
        if b - a <= self.p.silence:
            return True
        return b - a <= self.p.bridge and self.motion.any and self.motion.active(a, b) >= (0.55 if b - a <= 2.8 else 0.50)

    # --- cuts ---
    def _piece(self, s: Span, t: np.ndarray) -> Span:
        return replace(s, start=t[0] - self.p.serve_pad, end=t[-1] + self.p.land_pad, first=float(t[0]), last=float(t[-1]))

    def split(self, s: Span) -> list[Span]:
        t = self.hits.within(s.first, s.last)
        if len(t) < 2:
            return [s]
        cuts = [k for k in range(1, len(t)) if not self.live(t[k - 1], t[k])]
        out = []
        for g in np.split(t, cuts):
            isi, span = np.diff(g), g[-1] - g[0]
            blob = len(g) >= 5 and span > 10
            if len(g) >= 5 and (span > self.p.max_duration or blob):
                least = 1.40 if blob else max(1.85, 0.9 * self.p.silence)
                order = sorted(range(len(isi)), key=lambda k: (isi[k], k), reverse=True)[:5]  # the five largest holes, later ones first
                cut = next((k for k in order if isi[k] >= least and (not self.live(g[k], g[k + 1]) or blob and isi[k] >= 1.40 and self.motion.active(g[k], g[k + 1]) >= 0.48)), None)
                out += [g] if cut is None else [g[: cut + 1], g[cut + 1 :]]
            else:
                out.append(g)
        return [self._piece(s, g) for g in out]

    def trim_applause(self, s: Span) -> Span:
        t = self.hits.within(s.first, s.last)
        for k in range(2, len(t) - 5) if len(t) >= 7 else ():
            six = t[k : k + 6]
            isi = np.diff(six)
            if np.median(isi) < 0.36 and isi.max() < 0.60 and (six[0] >= s.first + 0.55 * (s.last - s.first) or six[-1] - six[0] >= 3.0):
                return s if t[k] <= s.first + 0.4 else replace(s, last=float(t[k]), end=min(s.end, float(t[k]) + self.p.land_pad))
        return s

    def trim_landing(self, s: Span) -> Span:
        t = self.hits.within(s.first, s.last)
        n = len(t)
        if n < 7 or not self.motion.any:
            return s
        for k in range(max(3, 2 * n // 5), n - 3):
            gap = t[k + 1] - t[k]
            in_play = gap > self.p.silence and self.live(t[k], t[k + 1])
            compact = gap < 1.55 and t[-1] - t[-2] <= 0.55
            if gap >= 1.32 and not in_play and not compact:
                return replace(s, first=float(t[0]), last=float(t[k]), end=min(s.end, float(t[k]) + self.p.land_pad))
        return s

    # --- anchoring ---
    def _quiet_serve(self, first: float, lo: float, hi: float) -> float | None:
        """A lone quiet pulse ``lo`` to ``hi`` before the first one, that could be the serve."""
        near = [x for x in self.hits.within(first - hi, first - lo) if lo < first - x <= hi]
        if not near:
            return None
        c = float(near[-1])
        lonely = not len(self.hits.within(c - 1.20, c - 0.08)) and not len(self.hits.within(c + 0.08, min(c + 1.20, first - 0.12)))
        calm = not self.motion.burst(max(0.0, c - 0.35), c + 0.25) and self.motion.active(c, first) < 0.42
        return c if lonely and calm and 1.5 <= self.hits.isolation(c) <= 6.0 else None

    def _serve_start(self, first: float) -> float:
        default = max(0.0, first - self.p.serve_pad)
        floor = max(0.0, first - min(2.4, max(self.p.serve_pad + 1.1, 2.0)))
        t, e = self.motion.part(floor, first + 0.12)
        on = e >= self.motion.level(0.08, 0.008) if len(e) else np.zeros(0, bool)
        if not on.any():
            return default
        back = on[::-1]
        begin = float(t[len(t) - 1 - self.motion.run(back, 3)])
        head = self.motion.active(max(0.0, begin - 1.4), begin)
        if head >= 0.55 and self.motion.active(max(0.0, first - 0.7), first + 0.15) < head + 0.05 and first - (begin - 0.30) > 1.1:
            return default  # it walked before: no toss
        return max(0.0, min(default, max(floor, begin - 0.30)))

    def anchor(self, s: Span) -> Span:
        h, m, p = self.hits, self.motion, self.p
        first, last, walked = s.first, s.last, False
        t = h.within(s.start - 0.25, s.end + 0.25)
        if len(t):
            first, last = float(t[0]), float(t[-1])
            pre = h.within(max(s.start - 0.55, first - 1.6), first - 0.12)
            if len(pre) == 1 and first - pre[0] <= 1.6:
                first = float(pre[0])
        t = h.within(first, last)
        if len(t) >= 5 and t[-1] - t[-2] <= 0.50 and h.isolation(t[0]) < 2.20 and t[-1] - t[0] >= 3.5 and np.diff(t[:-2]).min() >= 0.70:
            first, last, walked = float(t[-2]), float(t[-1]), True  # a walk, then a compact pair
        if not walked and len(t) >= 4 and t[-1] - t[0] <= 3.8 and m.burst(first, last):
            lead = h.within(first - 2.05, first - 0.12)
            if len(lead):
                c = float(lead[-1])
                calm = not len(h.within(c - 1.20, c - 0.08)) and not m.burst(max(0.0, c - 0.35), c + 0.25) and m.active(c, first) < 0.42
                if 1.70 < first - c <= 2.05 and calm and 2.8 <= h.isolation(c) <= 8.5:
                    first = c
        t = h.within(first, last)
        if not walked and len(t) >= 5 and t[-1] - t[-2] >= 0.50 and m.burst(first, last):
            serve = self._quiet_serve(first, 2.50, 5.75)
            if serve is None and np.diff(t).max() < 2.50:
                serve = self._quiet_serve(first, 2.16, 2.50)
            first = first if serve is None else serve
        t = h.within(first, last)
        n, iso, nx = len(t), h.isolation(first), h.gap_after(last)
        if not walked and n == 1 and 9.0 <= iso <= 30.0 and 1.80 <= nx <= 3.50:
            start = max(0.0, first - 5.60, h.before(first) + 0.35)
        else:
            start = max(0.0, first - p.serve_pad) if walked else self._serve_start(first)
        end = max(start + 0.25, last + p.land_pad)
        if m.any:
            shape = {"n": n, "iso": iso, "nx": nx, "fi": t[1] - t[0] if n > 1 else 0.0, "li": t[-1] - t[-2] if n > 1 else 0.0, "d": max(end - start, last + 2.20 - start)}
            if n == 3 and self._test(rules.COMPACT_THREE, shape):
                end = max(end, last + 2.20)
            elif m.active(last, last + p.land_pad + 0.35) < 0.22 and not (n == 1 and iso >= 3.2):
                end = min(end, last + min(0.45, p.land_pad))
            if n == 4 and 1.45 <= shape["li"] <= 1.80 and nx >= 4.0 and m.burst(first, last):
                end = max(end, last + 3.50)
        start = max(0.0, start)
        return replace(s, start=start, end=max(start + 0.25, end), first=first, last=last)

    # --- merging again ---
    def _joins(self, a: Span, b: Span, na: int, nb: int) -> bool:
        """Whether ``b`` continues ``a``; the alternatives are tried in order and the first that applies decides."""
        p, act = self.p, self.motion.active(a.last, b.first)
        gap, hole, joint = b.start - a.end, b.first - a.last, b.end - a.start
        if na >= 4 and a.last - a.first >= 4 and hole >= 1.5 and act >= 0.48 or joint > p.max_duration + 2:
            return False
        walk_in = bool(self._test(rules.WALK_IN, {"start_at": a.start, "first_at": a.first, "last_at": a.last, "d": a.duration, "n": na}))
        if gap <= p.remerge_gap and hole <= p.bridge:
            return self.live(a.last, b.first) or gap <= 0.45 and hole <= 1.8 and act < 0.62 or gap <= 0.60 and p.silence < hole <= 2.2 and act < 0.62 and joint <= 12 and na >= 2 and nb >= 3 and not walk_in
        lone = na == 1 and 3.30 <= self.hits.isolation(a.first) < 5 and self.hits.gap_after(a.last) >= 3.60
        return (
            hole <= p.silence
            or p.silence < hole <= 4.8 and joint <= p.max_duration and nb <= 2 <= na and act < 0.45 and not (nb == 1 and hole >= 3.2)
            or 3.2 < hole <= 5.2 and joint <= 8.5 and na <= 2 and nb <= 2 and act < 0.90 and not lone
            or 2.8 < hole <= 5.3 and joint <= p.max_duration and na <= 2 and nb >= 3 and act < 0.42
            or p.silence < hole <= 2.2 and joint <= 12 and na >= 2 and nb >= 3 and act < 0.55
        )

    def remerge(self, spans: list[Span]) -> list[Span]:
        h, out = self.hits, []
        for b in sorted(spans, key=lambda s: s.start):
            if not out:
                out.append(b)
                continue
            a = out[-1]
            ta, tb = h.within(a.first, a.last), h.within(b.first, b.last)
            gap, hole = b.start - a.end, b.first - a.last
            if gap < 0 and -0.05 <= hole <= 0.20 and len(ta) >= 3 and len(tb) >= 4 and not self.motion.burst(a.first, a.last) and self.motion.burst(b.first, b.last):
                own = ta[ta < b.first - 0.12]  # the pulse at the border is the later span's
                if len(own) and b.start - 0.35 > a.start + 0.5:
                    out[-1] = replace(a, last=float(own[-1]), end=min(a.end, b.start - 0.35, float(own[-1]) + self.p.land_pad))
                out.append(b)
            elif self._joins(a, b, len(ta), len(tb)):
                out[-1] = replace(a, end=max(a.end, b.end), last=max(a.last, b.last), confidence=min(a.confidence, b.confidence))
            elif 5.0 < hole <= 5.6 and 2 <= len(ta) <= 5 and len(tb) >= 4 and self.motion.active(a.last, b.first) < 0.40:
                out[-1] = replace(a, last=b.first, end=b.first + self.p.land_pad)  # the landing
                rest = tb[tb > b.first + self.p.silence]
                if len(rest) >= 2:
                    out.append(self._piece(b, rest))
            else:
                out.append(b)
        return out

    # --- peels ---
    def _dense(self, s: Span) -> np.ndarray | None:
        t = self.hits.within(s.first, s.last)
        return t if len(t) >= 10 and s.duration >= 6 and len(t) / max(0.25, s.last - s.first) > 1.7 and self.motion.any else None

    @staticmethod
    def _out_run(court: list[bool], k: int) -> int:
        n = 0
        while k + n < len(court) and not court[k + n]:
            n += 1
        return n

    def peel_court(self, s: Span) -> Span | None:
        """The first cluster of the own court, off a dense blob that goes on next door."""
        t = self._dense(s)
        if t is None or self.hits.isolation(s.first) < 3.20:
            return None
        court = [self.motion.in_court(x) for x in t]
        cut, pair = None, False
        for k in range(1, len(t)):
            away = self._out_run(court, k)
            if t[k] - t[k - 1] >= 1.00 and k >= 3:
                cut = k
            elif away >= 2:
                cut, pair = (2, True) if k == 1 and court[0] else (k, False)
            elif away == 1 and k >= 3 and sum(court[:k]) >= 3:
                cut = k
            if cut is not None:
                break
        if cut is None or cut >= len(t) or cut < 3 and not pair or not any(court[:cut]) or self._out_run(court[:cut], 0) >= 2:
            return None
        return None if cut >= 8 and np.median(np.diff(t[:cut])) < 0.42 else replace(s, start=max(0.0, t[0] - self.p.serve_pad), end=t[cut - 1] + self.p.land_pad, first=float(t[0]), last=float(t[cut - 1]), peeled=True)

    def peel_core(self, s: Span) -> Span | None:
        """The core in court behind one or two pulses from outside."""
        t = self._dense(s)
        if t is None or self.hits.isolation(s.first) >= 3.20:
            return None
        court = [self.motion.in_court(x) for x in t]
        k0 = self._out_run(court, 0)
        if not 1 <= k0 <= 2 or sum(court[k0:]) < 8:
            return None
        start, k = max(0.0, t[k0] - self.p.serve_pad), k0 + 1
        while k < len(t) and t[k] + self.p.land_pad - start < 6.0 and not (t[k] - t[k - 1] >= 1.00 and k - k0 >= 3) and self._out_run(court, k) < 2:
            k += 1
        core = t[k0:k]
        if len(core) < 3 or len(core) >= 8 and np.median(np.diff(core)) < 0.42:
            return None
        return replace(s, start=start, end=core[-1] + self.p.land_pad, first=float(core[0]), last=float(core[-1]), peeled=False)

    def play_end(self, last: float) -> float:
        """The end of play that goes on in silence after a pulse."""
        t, e = self.motion.part(last, last + 3.5)
        end = last + self.p.land_pad
        if not len(t):
            return end
        reach, quiet = last, 0
        for x, on in zip(t, e >= self.motion.level(0.28, 0.014), strict=True):
            reach, quiet = (float(x), 0) if on else (reach, quiet + 1)
            if quiet > 3 and x >= last + 0.80:
                break
        return max(end, min(last + 3.5, reach + 0.45))

    def peel_serve(self, s: Span) -> Span | None:
        """The last pulse of a walking blob, when play goes on after it."""
        t = self.hits.within(s.first, s.last)
        if len(t) < 7 or not 1.05 <= t[-1] - t[-2] <= 1.40 or self.hits.gap_after(t[-1]) < 5.2 or not self.motion.burst(t[-1], t[-1] + 2.8):
            return None
        start = max(0.0, t[-1] - self.p.serve_pad)
        return replace(s, start=start, end=max(start + 0.25, self.play_end(float(t[-1]))), first=float(t[-1]), last=float(t[-1]), peeled=False)

    def apply(self, spans: list[Span]) -> list[Span]:
        pieces = [self.trim_landing(self.trim_applause(self.anchor(x))) for s in spans for x in self.split(s)]
        kept: list[Span] = []
        for s in self.remerge(pieces):
            s = self.trim_landing(self.anchor(self.trim_applause(s)))
            court = self.peel_court(s)
            if court is not None:
                s = replace(self.anchor(court), peeled=True)
            tries = (s, self.peel_core(s), self.peel_serve(s))
            good = next((x for x in tries if x is not None and self.reject_rule(x) is None), None)
            if good is not None:
                kept.append(good)
        return self.dedupe(kept)

    @staticmethod
    def dedupe(spans: list[Span]) -> list[Span]:
        out: list[Span] = []
        for s in sorted(spans, key=lambda x: x.start):
            if out and s.start <= out[-1].end + 0.15:
                if s.last - s.first > out[-1].last - out[-1].first:
                    out[-1] = s
            else:
                out.append(s)
        return out


SCHEMA = "stream_id long, start double, end double, first double, last double, confidence double"


def filter_streams(spans: DataFrame, pulses: DataFrame, energy: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """Highlights of every stream.

    ``spans`` (stream_id, start, end, first, last, confidence), ``pulses`` (stream_id, ts), ``energy`` (stream_id, ts, energy), all in
    seconds.  Each table becomes one row of arrays for each stream; the arrays meet by stream.
    """
    s = spans.groupBy("stream_id").agg(F.collect_list(F.struct("start", "end", "first", "last", "confidence")).alias("s"))
    h = pulses.groupBy("stream_id").agg(F.sort_array(F.collect_list("ts")).alias("h"))
    e = energy.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("ts", "energy"))).alias("e"))
    rows = s.join(h, "stream_id", "left").join(e, "stream_id", "left").select("stream_id", "s", "h", F.col("e.ts").alias("t"), F.col("e.energy").alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda x: x if x is not None else []
        for f in frames:
            out = []
            for stream, items, hits, t, v in f.itertuples(index=False):
                flt = HighlightFilter(Hits(some(hits)), Motion(some(t), some(v)), profile)
                out += [(stream, x.start, x.end, x.first, x.last, x.confidence) for x in flt.apply([Span(**(i if isinstance(i, dict) else i.asDict())) for i in items])]
            yield pd.DataFrame(out, columns=["stream_id", "start", "end", "first", "last", "confidence"])

    return rows.mapInPandas(run, SCHEMA)
