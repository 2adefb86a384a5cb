"""SQL of the mappers' forward passes, for weights that a formula gives.

Every value of a pass is a relation (vec_id, n, d, v): row, token, feature. Weights follow
from the place of their parameter among ``param_shapes`` and their own indices, so SQL
states them as expressions; the same numbers fill the numpy parameters.
"""

from __future__ import annotations

import math

import numpy as np

from tensorloom.operators.fit import AdamW
from tensorloom.operators.mappers import MapperSpec, Params, param_shapes


def formula_params(spec: MapperSpec) -> Params:
    """Weights cos(k + i + 4 j) / sqrt(n_in), biases and shifts 0.1 sin(k + j), gains 1 + 0.1 cos(k + j)."""
    out: Params = {}
    for k, (name, shape) in enumerate(param_shapes(spec).items()):
        if name.endswith(".w"):
            i, j = np.arange(shape[0])[:, None], np.arange(shape[1])[None, :]
            out[name] = np.cos(k + i + 4.0 * j) / math.sqrt(shape[0])
        else:
            j = np.arange(shape[0], dtype=np.float64)
            out[name] = 1 + 0.1 * np.cos(k + j) if name.endswith(".g") else 0.1 * np.sin(k + j)
    return out


def erf_sql(z: str, terms: int = 70) -> str:
    """erf by its series with positive terms, exact to double precision for |z| < 5."""
    nested = "1.0::DOUBLE"
    for n in range(terms, 0, -1):
        nested = f"(1.0::DOUBLE + 2 * zz / {2 * n + 1} * {nested})"
    series = f"1.1283791670955126::DOUBLE * z * exp(-zz) * {nested}"
    return f"(SELECT CASE WHEN abs(z) > 5 THEN sign(z) ELSE {series} END FROM (SELECT {z} AS z, ({z}) * ({z}) AS zz))"


class ForwardSql:
    """Common table expressions of one pass; ``ctes`` holds them in order."""

    def __init__(self, spec: MapperSpec, source: str):
        self.spec, self.shapes = spec, param_shapes(spec)
        self.place = {name: k for k, name in enumerate(self.shapes)}
        self.ctes: list[str] = []
        self.h = self._add(source)

    def _add(self, sql: str) -> str:
        name = f"f{len(self.ctes)}"
        self.ctes.append(f"{name} AS MATERIALIZED ({sql})")
        return name

    def affine(self, x: str, name: str) -> str:
        n_in, n_out = self.shapes[f"{name}.w"]
        weight = f"cos(({self.place[f'{name}.w']} + d + 4 * o)::DOUBLE) / {math.sqrt(n_in)!r}::DOUBLE"
        bias = f"0.1::DOUBLE * sin(({self.place[f'{name}.b']} + o)::DOUBLE)"
        return self._add(f"SELECT vec_id, n, o AS d, sum(v * {weight}) + {bias} AS v FROM {x}, range({n_out}) r(o) GROUP BY vec_id, n, o")

    def gelu(self, x: str) -> str:
        # the series as a lateral scalar; z and zz are its own columns
        inner = erf_sql("v * 0.7071067811865476::DOUBLE")
        return self._add(f"SELECT vec_id, n, d, 0.5::DOUBLE * v * (1 + {inner}) AS v FROM {x}")

    def norm(self, x: str, name: str) -> str:
        if f"{name}.g" not in self.place:
            return x
        gain = f"(1 + 0.1::DOUBLE * cos(({self.place[f'{name}.g']} + d)::DOUBLE))"
        shift = f"0.1::DOUBLE * sin(({self.place[f'{name}.s']} + d)::DOUBLE)"
        return self._add(f"""SELECT vec_id, n, d, (v - m) / sqrt(s + 1e-5::DOUBLE) * {gain} + {shift} AS v
FROM (SELECT *, avg(v) OVER w AS m, var_pop(v) OVER w AS s FROM {x} WINDOW w AS (PARTITION BY vec_id, n))""")

    def plus(self, x: str, y: str) -> str:
        return self._add(f"SELECT a.vec_id, a.n, a.d, a.v + b.v AS v FROM {x} a JOIN {y} b ON b.vec_id = a.vec_id AND b.n = a.n AND b.d = a.d")

    def attend(self, x: str, name: str) -> str:
        dim, heads = self.spec.dim, self.spec.heads
        wide = dim // heads
        qkv = self.affine(x, f"{name}.qkv")
        part = lambda p: f"(SELECT vec_id, n, (d % {dim}) // {wide} AS h, d % {wide} AS e, v FROM {qkv} WHERE d // {dim} = {p})"
        score = self._add(f"""SELECT q.vec_id, q.h, q.n, k.n AS m, exp(sum(q.v * k.v) / {math.sqrt(wide)!r}::DOUBLE) AS v
FROM {part(0)} q JOIN {part(1)} k ON k.vec_id = q.vec_id AND k.h = q.h AND k.e = q.e GROUP BY q.vec_id, q.h, q.n, k.n""")
        mixed = self._add(f"""SELECT s.vec_id, s.n, s.h * {wide} + t.e AS d, sum(s.v * t.v) / sum(s.v) AS v FROM {score} s
JOIN {part(2)} t ON t.vec_id = s.vec_id AND t.h = s.h AND t.n = s.m GROUP BY s.vec_id, s.n, s.h, t.e""")
        return self.affine(mixed, f"{name}.out")

    def features(self) -> str:
        spec, x = self.spec, self.h
        if spec.kind == "mlp":
            for i in range(spec.layers):
                x = self.gelu(self.norm(self.affine(x, f"mlp{i}"), f"mlp{i}.ln"))
        if spec.kind.startswith("transformer"):
            x = self.norm(x, "pre")
            for i in range(spec.attention):
                x = self.plus(x, self.attend(self.norm(x, f"att{i}.ln"), f"att{i}"))
                inner = self.gelu(self.affine(self.norm(x, f"ffn{i}.ln"), f"ffn{i}.up"))
                x = self.plus(x, self.affine(inner, f"ffn{i}.down"))
            x = self.norm(x, "post")
        if spec.kind.endswith("resnet"):
            x = self.norm(self.gelu(self.affine(x, "enter")), "enter.ln")
            for i in range(spec.blocks):
                inner = self.norm(self.gelu(self.affine(x, f"res{i}a")), f"res{i}a.ln")
                x = self.plus(x, self.norm(self.gelu(self.affine(inner, f"res{i}b")), f"res{i}b.ln"))
        return x


def score_sql(spec: MapperSpec, elements: str, up: str) -> str:
    """Mean and corner values of the upsampled latents of every row.

    ``elements`` is a query of (vec_id, i, v); ``up`` the weights CTE w(o, s, k) of one axis.
    """
    f = ForwardSql(spec, f"SELECT vec_id, i // {spec.dim} AS n, i % {spec.dim} AS d, v FROM ({elements})")
    h = f.features()
    mean, logvar = f.affine(h, "mean"), f.affine(h, "logvar")
    g = spec.grid
    raised = []
    for x in (mean, logvar):
        raised.append(f._add(f"""SELECT vec_id, d * {4 * g * g} + wy.o * {2 * g} + wx.o AS i, sum(v * wy.k * wx.k) AS v FROM {x}
JOIN w wy ON wy.s = n // {g} JOIN w wx ON wx.s = n % {g} GROUP BY vec_id, d, wy.o, wx.o"""))
    last = spec.latent * 4 * g * g - 1
    return f"""WITH {up}, {", ".join(f.ctes)},
m AS (SELECT vec_id, count(*)::INTEGER AS n_values, avg(v) AS a, max(CASE WHEN i = 0 THEN v END) AS first FROM {raised[0]} GROUP BY vec_id),
l AS (SELECT vec_id, avg(v) AS a, max(CASE WHEN i = {last} THEN v END) AS last FROM {raised[1]} GROUP BY vec_id)
SELECT m.vec_id, n_values, round(m.a, 3) AS mean_avg, round(l.a, 3) AS logvar_avg, round(first::FLOAT::DOUBLE, 3) AS first_cell,
  round(last::FLOAT::DOUBLE, 3) AS last_cell FROM m JOIN l ON l.vec_id = m.vec_id"""


def training_sql(spec: MapperSpec, elements: str, up: str, truth: str, batches: str, steps: int, rate: str, beta: float, tag: str = "t") -> str:
    """CTEs of ``steps`` optimiser steps on the predicted means, from the formula weights; ``{tag}_log`` has (step, loss, mse, kl).

    For linear mappers and MLPs of one layer without norms. ``elements`` is a query of (vec_id, i, v), ``up`` the
    weights CTE w(o, s, k) of one axis, ``truth`` a relation (vec_id, c, y, x, mean, logvar) of the target cells, ``batches`` a
    relation (vec_id, batch), and ``rate`` the learning rate as an expression of the zero-based ``step``.
    """
    g, shapes = spec.grid, param_shapes(spec)
    ctes: list[str] = []

    def add(sql: str) -> str:
        ctes.append(f"{tag}{len(ctes)} AS MATERIALIZED ({sql})")
        return f"{tag}{len(ctes) - 1}"

    rows = []  # every weight as (p, i, j, w, m, v): parameter, input, output, value, moments
    for k, (name, shape) in enumerate(shapes.items()):
        value = f"cos((({k}) + i + 4 * j)::DOUBLE) / {math.sqrt(shape[0])!r}::DOUBLE" if name.endswith(".w") else f"0.1::DOUBLE * sin(({k} + j)::DOUBLE)"
        i, j = (shape if name.endswith(".w") else (1, shape[0]))
        rows.append(f"SELECT '{name}' AS p, i, j, {value} AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range({i}) a(i), range({j}) b(j)")
    state = add(" UNION ALL ".join(rows))
    x = add(f"SELECT vec_id, i // {spec.dim} AS n, i % {spec.dim} AS d, v FROM ({elements})")

    def affine(inputs: str, name: str) -> str:
        return add(f"""SELECT h.vec_id, h.n, k.j AS d, sum(h.v * k.w) + any_value(b.w) AS v FROM {inputs} h
JOIN {state} k ON k.p = '{name}.w' AND k.i = h.d JOIN {state} b ON b.p = '{name}.b' AND b.j = k.j GROUP BY h.vec_id, h.n, k.j""")

    def raised(tokens: str) -> str:
        return f"""SELECT vec_id, d AS c, wy.o AS y, wx.o AS x, sum(v * wy.k * wx.k) AS v FROM {tokens}
JOIN w wy ON wy.s = n // {g} JOIN w wx ON wx.s = n % {g} GROUP BY vec_id, d, wy.o, wx.o"""

    def lowered(cells: str, column: str) -> str:
        return add(f"""SELECT vec_id, wy.s * {g} + wx.s AS n, c AS d, sum({column} * wy.k * wx.k) AS v FROM {cells}
JOIN w wy ON wy.o = y JOIN w wx ON wx.o = x GROUP BY vec_id, wy.s, wx.s, c""")

    logs = []
    for step in range(steps):
        own = add(f"SELECT e.* FROM {x} e SEMI JOIN (SELECT vec_id FROM {batches} WHERE batch = {step}) b ON b.vec_id = e.vec_id")
        h = own
        if spec.kind == "mlp":
            pre = affine(own, "mlp0")
            half = add(f"SELECT vec_id, n, d, v AS pre, 0.5::DOUBLE * (1 + {erf_sql('v * 0.7071067811865476::DOUBLE')}) AS gate FROM {pre}")
            h = add(f"SELECT vec_id, n, d, pre * gate AS v FROM {half}")
        cells = add(f"""SELECT t.*, a.v AS pm, b.v AS pl, a.v - mean AS gap, exp(-logvar) AS inv, exp(b.v - logvar) AS ratio FROM {truth} t
JOIN ({raised(affine(h, "mean"))}) a ON a.vec_id = t.vec_id AND a.c = t.c AND a.y = t.y AND a.x = t.x
JOIN ({raised(affine(h, "logvar"))}) b ON b.vec_id = t.vec_id AND b.c = t.c AND b.y = t.y AND b.x = t.x""")
        log = add(f"""SELECT {step} AS step, avg(gap * gap) AS mse, avg(0.5::DOUBLE * (logvar - pl + ratio + gap * gap * inv - 1)) AS kl FROM {cells}""")
        logs.append(f"SELECT step, mse + {beta!r}::DOUBLE * kl AS loss, mse, kl FROM {log}")
        if step == steps - 1:
            break
        pulled = add(f"""SELECT vec_id, c, y, x, (2 * gap + {beta!r}::DOUBLE * gap * inv) / n AS dm, {beta!r}::DOUBLE * 0.5 * (ratio - 1) / n AS dl
FROM {cells}, (SELECT count(*)::DOUBLE AS n FROM {cells})""")
        heads = {"mean": lowered(pulled, "dm"), "logvar": lowered(pulled, "dl")}
        parts = []

        def grads(name: str, inputs: str, d: str) -> None:
            parts.append(f"SELECT '{name}.w' AS p, h.d AS i, o.d AS j, sum(h.v * o.v) AS g FROM {inputs} h JOIN {d} o ON o.vec_id = h.vec_id AND o.n = h.n GROUP BY h.d, o.d")  # noqa: B023
            parts.append(f"SELECT '{name}.b', 0, d, sum(v) FROM {d} GROUP BY d")  # noqa: B023

        for name, d in heads.items():
            grads(name, h, d)
        if spec.kind == "mlp":
            back = " UNION ALL ".join(f"SELECT o.vec_id, o.n, k.i AS d, o.v * k.w AS v FROM {d} o JOIN {state} k ON k.p = '{name}.w' AND k.j = o.d" for name, d in heads.items())
            deep = add(f"""SELECT s.vec_id, s.n, s.d, s.v * (gate + pre * exp(-0.5::DOUBLE * pre * pre) / 2.5066282746310002::DOUBLE) AS v
FROM (SELECT vec_id, n, d, sum(v) AS v FROM ({back}) GROUP BY vec_id, n, d) s JOIN {half} f ON f.vec_id = s.vec_id AND f.n = s.n AND f.d = s.d""")
            grads("mlp0", own, deep)
        grad = add(" UNION ALL ".join(parts))
        b1, b2, eps, decay = AdamW.BETA_1, AdamW.BETA_2, AdamW.EPS, AdamW.DECAY
        moved = add(f"""SELECT s.p, s.i, s.j, w, {b1}::DOUBLE * m + {1 - b1!r}::DOUBLE * g AS m, {b2}::DOUBLE * v + {1 - b2!r}::DOUBLE * g * g AS v
FROM {state} s JOIN {grad} d ON d.p = s.p AND d.i = s.i AND d.j = s.j""")
        state = add(f"""SELECT p, i, j, w * (1 - r * {decay}::DOUBLE) - r * (m / {1 - b1 ** (step + 1)!r}::DOUBLE)
  / (sqrt(v / {1 - b2 ** (step + 1)!r}::DOUBLE) + {eps}::DOUBLE) AS w, m, v FROM {moved}, (SELECT {rate.format(step=step)} AS r)""")
    ctes.append(f"{tag}_log AS ({' UNION ALL '.join(logs)})")
    return f"{up}, {', '.join(ctes)}" if up else ", ".join(ctes)
