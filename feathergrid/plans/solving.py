"""SQL that solves small symmetric systems: Gaussian elimination unrolled into nested selects."""

from __future__ import annotations


def pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i, size)]


def solve_sql(source: str, size: int, keys: str = "", carry: str = "") -> str:
    """A select of ``keys, carry, b0..`` with A b = r; ``source`` has columns ``a{i}_{j}`` (i <= j) and ``r{i}``."""
    lead = "".join(f"{c}, " for c in (keys, carry) if c)
    sql = f"select * from ({source})"
    for p in range(size - 1):
        done = [f"a{i}_{j}" for i, j in pairs(size) if i <= p] + [f"r{i}" for i in range(p + 1)]
        less = [f"a{i}_{j} - a{p}_{i} * a{p}_{j} / a{p}_{p} as a{i}_{j}" for i, j in pairs(size) if i > p]
        less += [f"r{i} - a{p}_{i} * r{p} / a{p}_{p} as r{i}" for i in range(p + 1, size)]
        sql = f"select {lead}{', '.join(done + less)} from ({sql})"
    for i in reversed(range(size)):
        known = "".join(f" - a{i}_{j} * b{j}" for j in range(i + 1, size))
        sql = f"select *, (r{i}{known}) / a{i}_{i} as b{i} from ({sql})"
    return f"select {lead}{', '.join(f'b{i}' for i in range(size))} from ({sql})"


def newton_ctes(
    rows: str, size: int, steps: int, keys: str = "", ridge: float | str = 0.0, start: str = "0.0", name: str = "b", trials: str = "1",
    first: str = "", offset: str = "",
) -> str:
    """CTEs ``{name}0 .. {name}{steps}``: coefficients ``b0..`` per key after each Newton step of a binomial model.

    ``rows`` names a relation with ``keys``, features ``v0..`` (v0 is 1), hits
    ``y`` of ``trials``.  ``ridge`` penalises all but ``b0``; ``offset`` is a
    column of the rows.  Steps begin at ``start`` for ``b0`` and 0, or at the select ``first``.
    """
    group = f" group by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    zero = ", ".join(f"{start if not i else '0.0'} as b{i}" for i in range(size))
    out = [f"{name}0 as materialized ({first or f'select {lead}{zero} from {rows}{group}'})"]
    eta = " + ".join([f"b{i} * v{i}" for i in range(size)] + [offset] * bool(offset))
    for s in range(1, steps + 1):
        prior = f"{rows} join {name}{s - 1} using ({keys})" if keys else f"{rows}, {name}{s - 1}"
        work = f"select *, {trials} / (1 + exp(-({eta}))) as mu, {trials} * exp(-({eta})) / pow(1 + exp(-({eta})), 2) as w from {prior}"
        a = ", ".join(f"sum(w * v{i} * v{j}){f' + {ridge}' if i == j and i and ridge else ''} as a{i}_{j}" for i, j in pairs(size))
        r = ", ".join(
            f"sum((y - mu) * v{i}){f' - {ridge} * any_value(b{i})' if i and ridge else ''} as r{i}" for i in range(size)
        )
        old = ", ".join(f"any_value(b{i}) as o{i}" for i in range(size))
        system = f"select {lead}{old}, {a}, {r} from ({work}){group}"
        solved = solve_sql(system, size, keys, ", ".join(f"o{i}" for i in range(size)))
        new = ", ".join(f"o{i} + b{i} as b{i}" for i in range(size))
        out.append(f"{name}{s} as materialized (select {lead}{new} from ({solved}))")
    return ",\n".join(out)


def inverse_diagonal_sql(source: str, size: int) -> str:
    """Rows ``i, d``: the diagonal of the inverse of the one system in ``source``."""
    parts = []
    for i in range(size):
        unit = ", ".join(f"{float(i == j)}::double as r{j}" for j in range(size))
        a = ", ".join(f"a{p}_{q}" for p, q in pairs(size))
        parts.append(f"select {i} as i, b{i} as d from ({solve_sql(f'select {a}, {unit} from ({source})', size)})")
    return " union all ".join(parts)


def hessian_sql(rows: str, size: int, model: str, trials: str = "1", offset: str = "") -> str:
    """The negative Hessian of a binomial model over ``rows`` at the coefficients in ``model``."""
    eta = " + ".join([f"b{i} * v{i}" for i in range(size)] + [offset] * bool(offset))
    a = ", ".join(f"sum(w * v{i} * v{j}) as a{i}_{j}" for i, j in pairs(size))
    return f"select {a} from (select *, {trials} * exp(-({eta})) / pow(1 + exp(-({eta})), 2) as w from {rows}, {model})"


def hash_sql(source: str, column: str, rounds: tuple[tuple[int, int], ...], prime: int) -> str:
    """``source`` with a whole number in ``column`` hashed by rounds of shift, exclusive or and multiplication."""
    for shift, factor in rounds:
        source = f"select * replace (xor({column}, {column} >> {shift}) * {factor} % {prime} as {column}) from ({source})"
    return source
