"""Folds over the frames of a clip: smoothing, a following camera, the speaking face, the moving mouth.

Frames are streamed in order with a state of a few numbers (see operators.folds), so a clip of any length is bounded.
``key_schema`` is the keys' part of the result's schema.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from spanloom.operators.folds import ordered_fold


class _Smooth:
    def __init__(self, keep: float):
        self.keep, self.last = keep, None

    def add(self, row) -> list[tuple]:
        x = float(row.value)
        self.last = x if self.last is None else self.keep * self.last + (1 - self.keep) * x
        return [(row.place, self.last)]

    def end(self) -> list[tuple]:
        return []


def smoothed(values: DataFrame, keys: list[str], key_schema: str, keep: float = 0.7) -> DataFrame:
    """keys, place, smooth: an exponential average of values (keys, place, value) that keeps ``keep`` of the last one."""
    return ordered_fold(values.select(*keys, "place", "value").filter("value IS NOT NULL"), keys, ["place"], lambda: _Smooth(keep), f"{key_schema}, place bigint, smooth double")


class _Follow:
    def __init__(self, crop: float, frame: float, safe: float, slow: float, fast: float):
        self.crop, self.frame, self.safe, self.slow, self.fast, self.at = crop, frame, safe, slow, fast, frame / 2

    def add(self, row) -> list[tuple]:
        aim = float(row.value)
        away = aim - self.at
        if abs(away) > self.crop * self.safe:
            pace = self.fast if abs(away) > self.crop / 2 else self.slow
            self.at = aim if abs(away) <= pace else self.at + math.copysign(pace, away)
        self.at = max(self.crop / 2, min(self.at, self.frame - self.crop / 2))
        return [(row.place, self.at)]

    def end(self) -> list[tuple]:
        return []


def followed(centers: DataFrame, keys: list[str], key_schema: str, crop: float, frame: float, safe: float = 0.25, slow: float = 3.0, fast: float = 15.0) -> DataFrame:
    """keys, place, center: a camera ``crop`` wide that rests while the target (keys, place, value) is near its middle and
    else moves by a bounded step, never past the target or out of the frame. It starts in the middle of the frame."""
    return ordered_fold(centers.select(*keys, "place", "value").filter("value IS NOT NULL"), keys, ["place"], lambda: _Follow(crop, frame, safe, slow, fast), f"{key_schema}, place bigint, center double")


@dataclass
class _Speaker:
    """Known faces by id: where they were and when; each one's score; the one that is shown."""

    width: float
    cooldown: int
    forget: int
    known: dict = field(default_factory=dict)
    scores: dict = field(default_factory=dict)
    shown: int | None = None
    switched: int = -10_000
    fresh: int = 0

    def add(self, row) -> list[tuple]:
        now = int(row.place)
        self.known = {i: k for i, k in self.known.items() if now - k[1] <= self.forget}
        here: dict[int, object] = {}
        for face in row.faces if row.faces is not None else []:
            middle = face["x"] + face["w"] / 2
            near = [(abs(middle - k[0]), i) for i, k in self.known.items() if i not in here and abs(middle - k[0]) < self.width * 0.15]
            if near:
                name = min(near)[1]
            else:
                name, self.fresh = self.fresh, self.fresh + 1
            here[name] = face
            self.known[name] = (middle, now)
        self.scores = {i: s * 0.85 for i, s in self.scores.items() if s * 0.85 >= 0.1}
        for i, face in here.items():
            self.scores[i] = self.scores.get(i, 0.0) + face["score"] / (self.width * self.width * 0.05)
        if not here:
            return [(now, None, None)]
        best = max(here, key=lambda i: self.scores[i] * (3.0 if i == self.shown else 1.0))
        if best != self.shown:
            if now - self.switched < self.cooldown and self.shown in here:
                best = self.shown
            else:
                self.shown, self.switched = best, now
        return [(now, best, here[best]["x"] + here[best]["w"] / 2)]

    def end(self) -> list[tuple]:
        return []


def speaking_face(frames: DataFrame, keys: list[str], key_schema: str, width: float, cooldown: int = 30, forget: int = 30) -> DataFrame:
    """keys, place, face, center: the face to show in each frame (keys, place, faces: array of x, y, w, h, score).

    A face is the known one nearest to it, within 15 % of the width and not yet taken in its frame, else a new one.
    Scores decay by 15 % a frame; the shown face counts three times and stays for ``cooldown`` frames while it is seen.
    Frames without faces show none.
    """
    rows = frames.select(*keys, "place", "faces")
    return ordered_fold(rows, keys, ["place"], lambda: _Speaker(width, cooldown, forget), f"{key_schema}, place bigint, face int, center double")


@dataclass
class _Mouth:
    hold: float
    switch: float
    scores: list = field(default_factory=lambda: [0.0, 0.0])
    shown: int | None = None
    waiting: int | None = None
    since: float = 0.0
    heard: float = -1_000.0
    switched: float = -1_000.0

    def add(self, row) -> list[tuple]:
        t = float(row.place)
        if row.moves is None or len(row.moves) != 2:
            self.scores, self.shown, self.waiting = [0.0, 0.0], None, None
            return [(t, None)]
        self.scores = [0.7 * s + 0.3 * max(0.0, float(m)) for s, m in zip(self.scores, row.moves)]
        best = 0 if self.scores[0] >= self.scores[1] else 1
        top, other = self.scores[best], self.scores[1 - best]
        if row.rms >= 0.008 and top >= 1.2 and top >= 1.5 * other + 0.5:
            self.heard = t
            if self.waiting != best:
                self.waiting, self.since = best, t
            if t - self.since >= self.hold and (self.shown in (None, best) or t - self.switched >= self.switch):
                self.switched = t if self.shown != best else self.switched
                self.shown = best
        else:
            self.waiting = None
            if t - self.heard > 0.5:
                self.shown = None
        return [(t, self.shown)]

    def end(self) -> list[tuple]:
        return []


def moving_mouth(frames: DataFrame, keys: list[str], key_schema: str, hold_s: float = 0.4, switch_s: float = 1.0) -> DataFrame:
    """keys, place, side: which of two faces speaks (0 left, 1 right, null unknown) at each time.

    ``frames``: keys, place (seconds), moves (how much each mouth moved, from left to right), rms of the sound. A side
    must lead clearly for ``hold_s`` and may replace the other after ``switch_s``; half a second without evidence ends it.
    """
    rows = frames.select(*keys, "place", "moves", "rms")
    return ordered_fold(rows, keys, ["place"], lambda: _Mouth(hold_s, switch_s), f"{key_schema}, place double, side int")
