"""Prompt templates: files of a name, inputs and a template text, rendered as columns."""

from __future__ import annotations

import pathlib
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLOT = re.compile(r"\{\{\$(\w+)\}\}")


@dataclass(frozen=True)
class Prompt:
    name: str
    inputs: tuple[str, ...]
    template: str


def parse_prompt(text: str) -> Prompt:
    """Reads the keys ``name``, ``input_variables`` and ``template`` of a prompt file.

    The template is the indented block after ``template: |``. A slot that is no
    declared input is an error, as is a file without name or template.
    """
    lines = text.split("\n")
    name, inputs, block, within = "", [], None, ""
    for line in lines:
        if block is not None and (line.startswith(" ") or not line.strip()):
            block.append(line)
            continue
        top = re.match(r"(\w+):\s*(.*)$", line)
        if top:
            within, value = top.groups()
            if within == "name":
                name = value.strip()
            block = [] if within == "template" and value.strip() == "|" else None
        elif within == "input_variables" and (found := re.match(r"\s+-\s+name:\s*(\w+)", line)):
            inputs.append(found[1])
    if not name or not block:
        raise ValueError("a prompt needs a name and a template")
    indent = min(len(b) - len(b.lstrip()) for b in block if b.strip())
    template = "\n".join(b[indent:] for b in block).strip("\n")
    unknown = set(_SLOT.findall(template)) - set(inputs)
    if unknown:
        raise ValueError(f"slots without inputs: {', '.join(sorted(unknown))}")
    return Prompt(name, tuple(inputs), template)


def shipped(name: str) -> Prompt:
    """A prompt of this package."""
    return parse_prompt((pathlib.Path(__file__).parent.parent / "prompts" / f"{name}.yaml").read_text(encoding="utf-8"))


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each slot replaced by its column; values are not looked into for slots."""
    parts = _SLOT.split(template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])
