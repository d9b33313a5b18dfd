"""Deterministic game roll-outs as row generators: a seed gives the same labelled frames anywhere.

Each game is a small simulator with a planner; an episode follows the planner and sometimes strays.  Frames are
JSON snapshots, not pictures.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assembly import phrased

# Moves of the snake in the order of their labels.
MOVES = {"up": (0, -1), "down": (0, 1), "left": (-1, 0), "right": (1, 0)}
# Fixed values of the bird's world, in cells and frames.
BIRD = {"frames": 10, "gravity": 0.0088, "flap": -0.168, "fall": 0.24, "scroll": 0.044, "x": 6.0, "r": 0.32, "pipe": 1.6, "spacing": 9.0, "gap": (3.8, 6.0), "width": 24, "height": 16}
# Fixed values of the brick wall's world.
BRICKS = {"width": 20, "height": 16, "frames": 8, "r": 0.26, "speed": 0.16, "paddle": 3.2, "row": 15.0, "step": 1.1, "rows": range(1, 7), "lives": 3}
ACTIONS = ("left", "right", "hold")


class Snake:
    """Body cells head first on a board; searches flood the board from a goal and read distances off it."""

    def __init__(self, seed: int, length: int, width: int = 24, height: int = 16):
        self.size = (width, height)
        self.body = [(width // 2 - i, height // 2) for i in range(length)]
        self.chance = random.Random(seed)
        self.meals = self.tick = self.fast = 0
        self.alive = True
        self.food = self.place()

    def place(self):
        taken = set(self.body)
        free = [(x, y) for y in range(self.size[1]) for x in range(self.size[0]) if (x, y) not in taken]
        return self.chance.choice(free) if free else None

    def around(self, cell):
        for dx, dy in MOVES.values():
            x, y = cell[0] + dx, cell[1] + dy
            if 0 <= x < self.size[0] and 0 <= y < self.size[1]:
                yield x, y

    def flood(self, start, walls) -> dict:
        """Steps from ``start`` to every cell in reach."""
        steps, ring = {start: 0}, [start]
        while ring:
            outer = []
            for cell in ring:
                for near in self.around(cell):
                    if near not in steps and near not in walls:
                        steps[near] = steps[cell] + 1
                        outer.append(near)
            ring = outer
        return steps

    def moved(self, body, cell):
        return [cell, *body] if cell == self.food else [cell, *body[:-1]]

    def has_way_back(self, body) -> bool:
        return len(body) <= 3 or body[-1] in self.flood(body[0], set(body[1:-1]))

    def options(self) -> dict:
        """Legal moves with the body each leads to."""
        out = {}
        for name, (dx, dy) in MOVES.items():
            cell = self.body[0][0] + dx, self.body[0][1] + dy
            walls = set(self.body if cell == self.food else self.body[:-1])
            walls.add(self.body[1])
            if cell in set(self.around(self.body[0])) and cell not in walls:
                out[name] = self.moved(self.body, cell)
        return out

    def route(self, body) -> list | None:
        """Cells of a shortest way from the head of ``body`` to the food."""
        if body[0] == self.food:
            return [body[0]]
        steps = self.flood(self.food, set(body[1:-1]))
        if body[0] not in steps:
            return None
        way = [body[0]]
        while way[-1] != self.food:
            way.append(next(c for c in self.around(way[-1]) if steps.get(c, -1) == steps[way[-1]] - 1))
        return way

    def choose(self) -> tuple[str | None, list[str]]:
        """(the planner's move, safe moves): a shortest safe meal, else room and a long way to the tail."""
        legal = self.options()
        safe = {d: b for d, b in legal.items() if self.has_way_back(b)}
        if not safe:
            return next(iter(legal), None), []
        hungry = self.fast > max(60, 2 * len(self.body))
        ways = sorted(((len(w), i, d, w) for i, (d, b) in enumerate(safe.items()) if self.food and (w := self.route(b))), key=lambda x: x[:2])
        for _, _, d, way in ways:
            body, kept = safe[d], True
            for cell in way[1:]:
                body = self.moved(body, cell)
                if not self.has_way_back(body):
                    kept = False
                    break
            if kept:
                return d, list(safe)
        if hungry and ways:
            return self.chance.choice([d for n, _, d, _ in ways if n == ways[0][0]]), list(safe)
        told = {}
        for d, body in safe.items():
            room = len(self.flood(body[0], set(body[1:])))
            told[d] = room, self.flood(body[0], set(body[1:-1])).get(body[-1], 0)
        if hungry:
            return self.chance.choice([d for d in told if told[d][0] >= len(safe[d])] or list(told)), list(safe)
        return max(told, key=told.get), list(safe)

    def go(self, name: str) -> None:
        body = self.options().get(name)
        self.tick += 1
        if body is None:
            self.alive = False
            return
        self.fast += 1
        ate = body[0] == self.food
        self.body = body
        if ate:
            self.meals, self.fast = self.meals + 1, 0
            self.food = self.place()

    def frames(self, stray: float, most: int, seed: int) -> Iterator[tuple[int, dict]]:
        dice = random.Random(seed + 1)
        while self.alive and self.food and self.tick < most:
            best, safe = self.choose()
            if best is None:
                return
            yield list(MOVES).index(best), {"body": self.body, "food": self.food, "score": self.meals, "tick": self.tick}
            self.go(dice.choice(safe or [best]) if dice.random() < stray else best)


class Bird:
    """Height, speed and the pipes ahead; an action is tried on a copy of the numbers, two decisions deep."""

    def __init__(self, seed: int):
        self.chance = random.Random(seed)
        self.y, self.v, self.score, self.alive = BIRD["height"] / 2, 0.0, 0, True
        self.pipes = [self.pipe(BIRD["width"] + 2 + i * BIRD["spacing"]) for i in range(3)]

    def pipe(self, x: float) -> tuple[float, float, float]:
        gap = self.chance.uniform(*BIRD["gap"])
        edge = gap / 2 + 1.2
        return x, self.chance.uniform(edge, BIRD["height"] - edge), gap

    @staticmethod
    def fly(y, v, pipes, flap):
        """(y, v, pipes, alive) after one decision."""
        v = BIRD["flap"] if flap else v
        for _ in range(BIRD["frames"]):
            v = min(v + BIRD["gravity"], BIRD["fall"])
            y += v
            if y < BIRD["r"]:
                y, v = BIRD["r"], 0.0
            pipes = [(x - BIRD["scroll"], c, g) for x, c, g in pipes]
            hit = any(abs(x - BIRD["x"]) < BIRD["pipe"] / 2 + BIRD["r"] and abs(y - c) > g / 2 - BIRD["r"] for x, c, g in pipes)
            if hit or y > BIRD["height"] - BIRD["r"]:
                return y, v, pipes, False
        return y, v, pipes, True

    def lasts(self, flap: bool) -> bool:
        y, v, pipes, alive = self.fly(self.y, self.v, self.pipes, flap)
        return alive and any(self.fly(y, v, pipes, then)[3] for then in (True, False))

    def choose(self) -> tuple[bool, bool]:
        """(flap, whether both actions last)."""
        _, centre, gap = min(p for p in self.pipes if p[0] + BIRD["pipe"] / 2 + BIRD["r"] > BIRD["x"])
        flap, hold = self.lasts(True), self.lasts(False)
        return (flap if flap != hold else self.y - centre > 0.08 * gap), flap and hold

    def go(self, flap: bool) -> None:
        passed = lambda ps: sum(x + BIRD["pipe"] / 2 < BIRD["x"] - BIRD["r"] for x, _, _ in ps)
        before = passed(self.pipes)
        self.y, self.v, self.pipes, self.alive = self.fly(self.y, self.v, self.pipes, flap)
        self.score += passed(self.pipes) - before
        if self.pipes[0][0] < -2:
            self.pipes = [*self.pipes[1:], self.pipe(self.pipes[-1][0] + BIRD["spacing"])]

    def frames(self, stray: float, most: int, seed: int) -> Iterator[tuple[int, dict]]:
        dice = random.Random(seed + 1)
        for tick in range(most):
            if not self.alive:
                return
            flap, free = self.choose()
            yield 0 if flap else 1, {"y": round(self.y, 3), "v": round(self.v, 3), "pipes": [[round(z, 3) for z in p] for p in self.pipes], "score": self.score, "tick": tick}
            self.go(flap != (dice.random() < stray and free))


class Bricks:
    """A ball as (x, y, vx, vy), the bricks left and a paddle that goes where the ball will land."""

    def __init__(self, seed: int):
        self.chance = random.Random(seed)
        self.wall = {(r, c) for r in BRICKS["rows"] for c in range(BRICKS["width"])}
        self.at, self.lives, self.score = BRICKS["width"] / 2, BRICKS["lives"], 0
        self.serve()

    def serve(self) -> None:
        a = self.chance.uniform(-0.6, 0.6)
        self.ball = self.at, BRICKS["row"] - 1, BRICKS["speed"] * math.sin(a), -BRICKS["speed"] * math.cos(a)

    @staticmethod
    def roll(ball, wall, paddle):
        """One frame; ``paddle`` None lets the ball through.  ``wall`` loses a brick that is hit."""
        x, y, vx, vy = ball
        x, y = x + vx, y + vy
        low, high = BRICKS["r"], BRICKS["width"] - BRICKS["r"]
        if not low <= x <= high:
            x, vx = (low, abs(vx)) if x < low else (high, -abs(vx))
        if y < low:
            y, vy = low, abs(vy)
        cell = int(y), int(x)
        if cell in wall:
            wall.remove(cell)
            return (x, y - vy * 0.5, vx, -vy), "brick"
        off = None if paddle is None else x - paddle
        if off is not None and vy > 0 and 0 <= y + low - BRICKS["row"] <= 0.6 and abs(off) <= BRICKS["paddle"] / 2 + low:
            vx, vy = vx + 0.22 * off / (BRICKS["paddle"] / 2), -abs(vy)
            k = BRICKS["speed"] / math.hypot(vx, vy)
            return (x, BRICKS["row"] - low, vx * k, vy * k), "paddle"
        return (x, y, vx, vy), "lost" if y - low > BRICKS["height"] else None

    def shifted(self, action: str) -> float:
        half = BRICKS["paddle"] / 2
        return min(max(self.at + {"left": -1, "right": 1, "hold": 0}[action] * BRICKS["step"], half), BRICKS["width"] - half)

    def choose(self) -> str:
        """The action that brings the paddle nearest to where the ball comes down."""
        ball, wall = self.ball, set(self.wall)
        for _ in range(400):
            ball, _ = self.roll(ball, wall, None)
            if ball[3] > 0 and ball[1] + BRICKS["r"] >= BRICKS["row"]:
                break
        free = [a for a in ACTIONS if a == "hold" or abs(self.shifted(a) - self.at) > 1e-9]
        return min(free, key=lambda a: abs(self.shifted(a) - ball[0]))

    def go(self, action: str) -> None:
        pace = (self.shifted(action) - self.at) / BRICKS["frames"]
        for _ in range(BRICKS["frames"]):
            self.at += pace
            self.ball, what = self.roll(self.ball, self.wall, self.at)
            if what == "brick":
                self.score += 10
                if not self.wall:
                    return
            if what == "lost":
                self.lives -= 1
                self.at = BRICKS["width"] / 2
                self.serve()
                return

    def frames(self, stray: float, most: int, seed: int) -> Iterator[tuple[int, dict]]:
        dice = random.Random(seed + 1)
        self.at = dice.uniform(2, 18)
        for tick in range(most):
            if not self.lives or not self.wall:
                return
            best = self.choose()
            yield ACTIONS.index(best), {"ball": [round(z, 3) for z in self.ball], "paddle": round(self.at, 3), "left": len(self.wall), "score": self.score, "lives": self.lives, "tick": tick}
            self.go(dice.choice(ACTIONS) if dice.random() < stray else best)


def start(game: str, seed: int):
    if game == "snake":
        return Snake(seed, random.Random(seed).randint(3, 8))
    return {"bird": Bird, "bricks": Bricks}[game](seed)


def rollouts(spark: SparkSession, game: str, seeds: int, most: int = 600, stray: float = 0.15, keep: float = 1.0) -> DataFrame:
    """(game, seed, tick, label, state, split): one task slot per seed; seeds in tens are the test split."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"].tolist():
                pick = random.Random(seed * 7919 + 1)
                rows = [(game, seed, t, label, json.dumps(state), "train" if seed % 10 else "test") for t, (label, state) in enumerate(start(game, seed).frames(stray, most, seed)) if pick.random() <= keep]
                yield pd.DataFrame(rows, columns=["game", "seed", "tick", "label", "state", "split"])

    return spark.range(seeds).mapInPandas(run, "game string, seed long, tick int, label int, state string, split string")


def game_questions(spark: SparkSession, folder: str, game: str, split: str, seed: str = "game", augment: bool = True) -> DataFrame:
    """Questions about the frames of a game: each row of `<game>.jsonl` (image, label, split) asked as `questions.json` has it.

    With ``augment`` a row draws its phrasing, label set and order of options; without, it takes the first of each as they are.
    """
    spec = json.loads(spark.read.text(f"{folder}/questions.json", wholetext=True).first()[0])
    told = spec["questions"][game]
    frames = spark.read.schema("image string, label int, split string").json(f"{folder}/{game}.jsonl").where(F.col("split") == split)
    rows = frames.withColumns({"source": F.lit(f"game:{game}"), "state": F.lit(spec["state"]), "type": F.lit("choice")})
    return phrased(rows, told["instructions"], told["labels"], seed, "image", augment)
