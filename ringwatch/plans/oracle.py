"""The platform views in DuckDB's dialect, as common table expressions."""

from __future__ import annotations

import re

from ringwatch.sources.platform import _SEALED, _VIEWS, BASE_MS, DAY_MS


def _duck(text: str) -> str:
    text = text.replace("{base}", str(BASE_MS)).replace("{day}", str(DAY_MS))
    text = re.sub(r"unix_millis\(cast\((\w+) AS timestamp\)\)", r"(epoch_us(\1) // 1000)", text)
    text = text.replace("concat('ring_', template_id)", "'ring_' || template_id")
    return re.sub(r"\{(\w+)\}", r"\1", text)


def with_views(sql: str) -> str:
    """``sql`` after definitions of the views it names."""
    texts = {**_VIEWS, "sealed_labels": _SEALED}
    needed: list[str] = []

    def need(text: str) -> None:
        for name in texts:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                if name == "sealed_labels":
                    need("comment")
                needed.append(name)

    need(sql)
    order = [n for n in texts if n in needed]
    ctes = ", ".join(f"{n} AS ({_duck(texts[n])})" for n in order)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, " + sql.lstrip()[14:] if ctes else sql
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, " + sql.lstrip()[5:] if ctes else sql
    return f"WITH {ctes} {sql}" if ctes else sql
