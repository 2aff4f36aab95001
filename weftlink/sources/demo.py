"""Fictional clinics with noisy copies, as tab-separated sources for trials and tests.

Every clinic is a row of source 1. A seeded draw decides how often a register of source 2
or 3 lists it, what each listing does to its text (noise operators, one after another),
and which other listings stand beside it: the same owner elsewhere, another practice in
the same house, and unrelated ones.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from pathlib import Path

from weftlink.operators.records import COLUMNS

SOUNDS = ("al", "bren", "cor", "dun", "eth", "fal", "gor", "hes", "il", "jor", "kel", "lum", "mar", "nev", "or", "pel", "quin", "ros", "sel", "tam")
FIELDS_OF_CARE = ("Dental", "Eye", "Foot", "Heart", "Skin", "Sports")
STATES = (("Ardmere", 0.55), ("Болград", 0.15), ("Caldia", 0.25), ("", 0.05))


def _word(draw: random.Random, sounds: int) -> str:
    return "".join(draw.choice(SOUNDS) for _ in range(sounds)).capitalize()


def _typo(draw: random.Random, text: str) -> str:
    """One letter doubled, left out, or changed with the next."""
    at = draw.randrange(1, max(2, len(text) - 1))
    return draw.choice((text[:at] + text[at - 1 :], text[:at] + text[at + 1 :], text[: at - 1] + text[at : at + 1] + text[at - 1 : at] + text[at + 1 :]))


NOISE: tuple[tuple[float, Callable[[random.Random, dict], None]], ...] = (
    (0.35, lambda draw, r: r.update(name=_typo(draw, r["name"]))),
    (0.25, lambda draw, r: r.update(name=" ".join(sorted(r["name"].split(), key=lambda _: draw.random())))),
    (0.30, lambda draw, r: r.update(form=draw.choice(("", "Pvt. Ltd.", "LLC", "Inc.")))),
    (0.30, lambda draw, r: r.update(way=r["way"].replace("Avenue", "Ave").replace("Lane", "Ln"))),
    (0.10, lambda draw, r: r.update(code="")),
    (0.06, lambda draw, r: r.update(way="", town="", code="")),
    (0.08, lambda draw, r: r.update(state="")),
)


def _listing(draw: random.Random, clinic: dict, noisy: bool) -> dict:
    r = dict(clinic)
    for chance, change in NOISE:
        if noisy and draw.random() < chance:
            change(draw, r)
    return r


def _line(key: str, r: dict) -> str:
    place = ", ".join(x for x in (r["way"], r["town"], f"{r['county']} {r['code']}".strip() if r["town"] else "") if x)
    return "\t".join((key, f"{r['name']} {r['form']}".strip(), place, r["state"]))


def make_demo(root: str, count: int = 100, seed: int = 20) -> None:
    """Writes the sources of a training and a test part under ``root``, and the truth of the first."""
    for part in ("train", "test"):
        draw = random.Random(f"{seed}/{part}")
        rows: dict[int, list[str]] = {n: ["\t".join(COLUMNS)] for n in (1, 2, 3)}
        owners = ["source1_entity_id\tmatched_entity_ids"]
        numbers = iter(draw.sample(range(10_000, 99_999), 8 * count + 8))
        for _ in range(count):
            clinic = {
                "name": f"{_word(draw, 2)} {draw.choice(FIELDS_OF_CARE)} Practice",
                "form": "Ltd.",
                "way": f"{draw.randrange(1, 400)} {_word(draw, 2)} {draw.choice(('Avenue', 'Lane', 'Street'))}",
                "town": _word(draw, 3),
                "county": f"{_word(draw, 2)} County",
                "code": str(draw.randrange(100_000, 999_999)),
                "state": draw.choices([s for s, _ in STATES], [w for _, w in STATES])[0],
            }
            anchor, matched = f"S1-{next(numbers)}", []
            rows[1].append(_line(anchor, clinic))
            for source, chance in ((2, 0.7), (3, 0.45)):
                if draw.random() < chance:
                    matched.append(f"S{source}-{next(numbers)}")
                    rows[source].append(_line(matched[-1], _listing(draw, clinic, noisy=True)))
            others = {
                "branch": clinic | {"way": f"{draw.randrange(400, 800)} {_word(draw, 2)} Street", "town": _word(draw, 3), "code": str(draw.randrange(100_000, 999_999))},
                "housemate": clinic | {"name": f"{_word(draw, 2)} {draw.choice(FIELDS_OF_CARE)} Rooms", "form": ""},
                "stranger": clinic | {"name": _word(draw, 4), "way": f"{draw.randrange(1, 400)} {_word(draw, 3)} Way", "town": _word(draw, 3), "code": ""},
            }
            for r in others.values():
                source = draw.choice((2, 3))
                if draw.random() < 0.8:
                    rows[source].append(_line(f"S{source}-{next(numbers)}", _listing(draw, r, noisy=False)))
            owners.append(f"{anchor}\t{','.join(matched)}")
        folder = Path(root, part)
        folder.mkdir(parents=True, exist_ok=True)
        for n, lines in rows.items():
            (folder / f"{part}_source{n}.tsv").write_text("\n".join(lines) + "\n")
        if part == "train":
            (folder / f"{part}_ground_truth.tsv").write_text("\n".join(owners) + "\n")
