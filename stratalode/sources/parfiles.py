"""Parameter files: titled sections of lines "values - comment"."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Line:
    default: str
    comment: str


def render(title: str, sections: dict[str, list[Line]], notes: dict[str, str] | None = None) -> str:
    """A parameter file with the defaults."""
    out = [f"\t\t  {title}", "\t\t  " + "-" * len(title), ""]
    for name, lines in sections.items():
        note = (notes or {}).get(name)
        out.append(f"START OF {name}:" + (f"       # {note}" if note else ""))
        out += [f"{x.default:<20}- {x.comment}" for x in lines]
        out.append("")
    return "\n".join(out) + "\n"


def parse(text: str, sections: list[str]) -> dict[str, list[list[str]]]:
    """{section: [the words of each line's values]}; a section ends at a blank line or the next title. A line's comment
    starts at its last dash that stands between blanks."""
    out: dict[str, list[list[str]]] = {}
    name = None
    for line in text.splitlines():
        started = next((s for s in sections if line.strip().startswith(f"START OF {s}:")), None)
        if started:
            name = started
            out[name] = []
        elif not line.strip():
            name = None
        elif name:
            values = line.rsplit(" - ", 1)[0] if " - " in line else line
            out[name].append(values.split())
    missing = [s for s in sections if s not in out]
    if missing:
        raise ValueError(f"no sections {missing}")
    return out


def read_par(path: str) -> str:
    with open(path) as f:
        return f.read()


def write_par(text: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(text)
