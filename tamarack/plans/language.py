"""The description language ``Name{opt=value opt2=sub{…}}``."""

from __future__ import annotations


def parse(text: str) -> tuple[str, dict[str, str]]:
    """``Name{opt=value opt2=sub{…}}`` as (name, options); braces nest."""
    text = text.strip()
    name, brace, rest = text.partition("{")
    if not brace:
        return text, {}
    if not rest.endswith("}"):
        raise ValueError(f"no closing brace: {text}")
    options, depth, word = {}, 0, ""
    for char in rest[:-1] + " ":
        depth += (char == "{") - (char == "}")
        if char.isspace() and depth == 0:
            if word:
                key, equals, value = word.partition("=")
                if not equals:
                    raise ValueError(f"{word} has no value")
                options[key] = value
            word = ""
        else:
            word += char
    if depth:
        raise ValueError(f"braces don't match: {text}")
    return name.strip(), options


def number(text: str) -> int | float:
    return float(text) if "." in text or "e" in text.lower() else int(text)
