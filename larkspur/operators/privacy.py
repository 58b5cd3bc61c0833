"""Private aggregates: values are clamped and Laplace noise is added; contributions are not bounded per privacy unit."""

from __future__ import annotations

from ..sql import nodes as n


def noisy(low, x: n.Expr, alias: str | None, options: dict) -> str:
    """One item of a private select list; grouping keys pass through."""
    if not isinstance(x, n.Call) or x.name.replace("ANON_", "") not in ("SUM", "COUNT", "AVG", "VAR_POP", "STDDEV_POP", "PERCENTILE_CONT", "QUANTILES"):
        return low.item(x, alias, None)
    name = x.name.replace("ANON_", "")
    epsilon = float(options["epsilon"].value) if "epsilon" in options else 1.0
    bounds = next((v for k, v in x.named.items() if "bounds" in k), None)
    low_b, high_b = [low.x(i[0]) for i in bounds.items] if isinstance(bounds, n.StructLit) else (None, None)
    arg = low.x(x.args[0]) if x.args and not isinstance(x.args[0], n.Star) else None
    if low_b and arg:
        arg = f"greatest({low_b}, least({high_b}, {arg}))"
    reach = f"greatest(abs({low_b}), abs({high_b}))" if low_b else "1"
    u = "greatest(rand(), 1e-12)"  # noise by the inverse distribution function of a uniform draw
    noise = f"((CASE WHEN rand() < 0.5 THEN 1 ELSE -1 END) * ln({u}) * double({reach}) / {epsilon!r}D)"
    text = {"COUNT": f"bigint(round(count({arg or '*'}) + {noise}))", "SUM": f"sum({arg}) + {noise}", "AVG": f"(sum({arg}) + {noise}) / greatest(count({arg}), 1)", "VAR_POP": f"greatest(var_pop({arg}) + {noise} / greatest(count({arg}), 1), 0D)", "STDDEV_POP": f"sqrt(greatest(var_pop({arg}) + {noise} / greatest(count({arg}), 1), 0D))"}.get(name)
    if text is None:
        text = f"percentile({arg}, {low.x(x.args[1])}) + {noise} / greatest(count({arg}), 1)"
    return f"{text} AS `{alias or low.unnamed()}`"
