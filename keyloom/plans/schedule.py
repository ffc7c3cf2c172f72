"""Schedules of two-dimensional loops: which tiles run together, and in which order."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Turn:
    """Slot ``slot`` runs tile (space, time) at a step; steps run one after another, sub-steps of a slot in order."""

    step: int
    sub: int
    slot: int
    space: int
    time: int


def rotation(slots: int, space_tiles: int, time_tiles: int) -> list[Turn]:
    """Unordered loops. At a step slot e has one time tile and runs all its space tiles with it; then time tiles move on."""
    turns, step = [], 0
    for time_sub in range(-(-time_tiles // slots)):
        for clock in range(slots):
            for slot in range(slots):
                time = time_sub * slots + (clock + slot) % slots
                for sub in range(-(-space_tiles // slots)):
                    space = sub * slots + slot
                    if time < time_tiles and space < space_tiles:
                        turns.append(Turn(step, sub, slot, space, time))
            step += 1
    return turns


def wavefront(space_tiles: int, time_tiles: int) -> list[Turn]:
    """Ordered loops. A step is an anti-diagonal of tiles, so every tile comes after those below it in either dimension."""
    return [
        Turn(step, 0, space, space, step - space)
        for step in range(space_tiles + time_tiles - 1)
        for space in range(max(0, step - time_tiles + 1), min(space_tiles, step + 1))
    ]


def closed_up(turns: list[Turn], most: int) -> list[list[tuple[int, int]]]:
    """(space, time) of turns in order, each at the first step after those before it that share one; at most ``most`` a step."""
    steps: list[list[tuple[int, int]]] = []
    after: dict[tuple[str, int], int] = {}
    for t in turns:
        at = max(after.get(("space", t.space), 0), after.get(("time", t.time), 0))
        while at < len(steps) and len(steps[at]) >= most:
            at += 1
        steps += [[] for _ in range(at + 1 - len(steps))]
        steps[at].append((t.space, t.time))
        after["space", t.space] = after["time", t.time] = at + 1
    return steps


def tile_size(dim: int, tiles: int) -> int:
    return max(1, -(-dim // tiles))
