"""Linear regression, one model per key, fitted for all keys together.

Squared loss needs only the means and covariances of a key, so one grouped aggregation fits every
key.  Huber loss repeats such an aggregation until the fits settle.  Neither collects a key's
rows: partial aggregation reduces a key of any size to one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scale
from ..scale import checkpoint, checkpoint_counted, small, spread
from .features import assemble
from .metrics import r2_column
from .params import LinearParams
from .per_key import per_key
from .rows import in_request_order, key_list_rows, project

_ANSWER = (
    "total_iterations int, rmse double, r2 double, intercept double, "
    "slopes array<double>, objective_history array<double>"
)


def linear_regression(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    params: LinearParams | None = None,
    keys: Sequence | None = None,
    nulls: str = "error",
) -> DataFrame:
    """Fit ``label`` on ``features`` for every key, or for the listed ``keys``.

    Gives ``(key, total_iterations, rmse, r2, intercept, slopes, objective_history)``, where
    ``rmse`` and ``r2`` are those of the training rows.  Keys without rows are skipped and rows
    without a key are left out.  A null feature or label is an error, or with ``nulls="drop"``
    drops its row.  ``r2`` is null where the labels do not vary.

    With squared loss the solution is exact; ``total_iterations`` is 0 and the history ``[0.0]``
    where no L1 penalty is set, and both are null with one.  An iterative solver
    (``solver="l-bfgs"``) runs MLlib for each of the listed keys, which it then needs.
    Huber loss adds ``scale``, beside which a residual counts as large.  With ``keys`` the answers have ``req_ord`` first: one row for each place of the list, a repeated
    key again.
    """
    params = params or LinearParams()
    if not features:
        raise ValueError("name at least one feature")
    if nulls not in ("error", "drop"):
        raise ValueError("nulls is 'error' or 'drop'")
    if params.loss not in ("squaredError", "huber"):
        raise ValueError("loss is 'squaredError' or 'huber'")
    if params.solver not in ("auto", "normal", "l-bfgs"):
        raise ValueError("solver is 'auto', 'normal' or 'l-bfgs'")
    if params.loss == "huber" and params.elastic_net > 0:
        raise ValueError("Huber loss takes an L2 penalty only")
    if params.loss == "huber" and params.solver == "normal":
        raise ValueError("Huber loss has no normal equations")

    rows = project(df, key, features, label).filter(F.col(key).isNotNull())
    rows = rows.withColumns(
        {name: F.col(name).cast("double") for name in dict.fromkeys([*features, "label"])}
    )
    if keys is not None:
        rows = key_list_rows(rows, key, keys)
    if nulls == "drop":
        rows = rows.na.drop()
    if params.solver == "l-bfgs":
        if keys is None:
            raise ValueError("an iterative solver runs one job per key: list the keys")
        return _mllib(rows, key, features, params, keys)
    if params.loss == "huber":
        fitted = _huber(rows, key, features, params)
    elif len(features) == 1:
        fitted = _one_feature(rows, key, features[0], params)
    else:
        fitted = _many_features(rows, key, features, params)
    return fitted if keys is None else in_request_order(fitted, key, keys)


def _mllib(rows: DataFrame, key: str, features, params: LinearParams, keys) -> DataFrame:
    def fit(mine: DataFrame) -> dict:
        estimator = LinearRegression(
            loss=params.loss,
            solver=params.solver,
            aggregationDepth=params.aggregation_depth,
            maxIter=params.max_iterations,
            epsilon=params.epsilon,
            elasticNetParam=params.elastic_net,
            regParam=params.reg_param,
            tol=params.tolerance,
            fitIntercept=params.fit_intercept,
            standardization=params.standardization,
        )
        model = estimator.fit(assemble(mine, features))
        summary = model.summary
        return {
            "total_iterations": summary.totalIterations,
            "rmse": summary.rootMeanSquaredError,
            "r2": summary.r2,
            "intercept": float(model.intercept),
            "slopes": [float(x) for x in model.coefficients],
            "objective_history": [float(x) for x in summary.objectiveHistory],
        }

    return per_key(rows, key, keys, fit, _ANSWER)


def _checked_count(columns: Sequence[str]) -> Column:
    """The row count of a group; a null in any of the columns is an error."""
    complete = F.lit(True)
    for name in columns:
        complete = complete & F.col(name).isNotNull()
    message = F.lit(f"null among {list(columns)}; pass nulls='drop' to leave such rows out")
    return F.when(F.count("*") > F.count_if(complete), F.raise_error(message).cast("bigint")).otherwise(
        F.count("*")
    )


def _history(params: LinearParams) -> tuple[Column, Column]:
    if params.elastic_net > 0 and params.reg_param > 0:
        return F.lit(None).cast("int"), F.lit(None).cast("array<double>")
    return F.lit(0), F.array(F.lit(0.0))


def _one_feature(rows: DataFrame, key: str, x: str, params: LinearParams) -> DataFrame:
    """Closed form from population moments; the penalties act on the standardised slope."""
    sums = rows.groupBy(key).agg(
        _checked_count([x, "label"]).alias("n"),
        F.avg(x).alias("mx"),
        F.avg("label").alias("my"),
        F.var_pop(x).alias("vx"),
        F.var_pop("label").alias("vy"),
        F.covar_pop(x, "label").alias("cxy"),
    )
    mx, my, vx, vy, cxy = (F.col(name) for name in ("mx", "my", "vx", "vy", "cxy"))
    sx, sy = F.sqrt(vx), F.sqrt(vy)
    l1 = F.lit(params.elastic_net * params.reg_param) / sy
    l2 = F.lit((1 - params.elastic_net) * params.reg_param) / sy
    if not params.standardization:
        l1, l2 = l1 / sx, l2 / vx
    if params.fit_intercept:
        xx, xy = F.lit(1.0), cxy / (sx * sy)
        flat = F.lit(0.0)
    else:
        xx, xy = (vx + mx * mx) / vx, (cxy + mx * my) / (sx * sy)
        # labels that do not vary have no scale: only plain least squares is defined there
        flat = (
            (cxy + mx * my) / (vx + mx * mx)
            if params.reg_param == 0
            else F.raise_error(
                F.lit("a key's labels do not vary: no penalty can be scaled without an intercept")
            ).cast("double")
        )
    shrunk = F.signum(xy) * F.greatest(F.abs(xy) - l1, F.lit(0.0)) / (xx + l2) * sy / sx
    slope = F.when(vx <= 0, F.lit(0.0)).when(vy <= 0, flat).otherwise(shrunk)
    fitted = sums.withColumn("slope", slope).withColumn(
        "intercept", my - F.col("slope") * mx if params.fit_intercept else F.lit(0.0)
    )
    slope, bias = F.col("slope"), my - F.col("slope") * mx - F.col("intercept")
    mse = F.greatest(vy - 2 * slope * cxy + slope * slope * vx + bias * bias, F.lit(0.0))
    total = vy if params.fit_intercept else vy + my * my
    iterations, history = _history(params)
    return fitted.select(
        key,
        iterations.alias("total_iterations"),
        F.when(F.col("n") > 0, F.sqrt(mse)).alias("rmse"),
        r2_column(mse, total).alias("r2"),
        "intercept",
        F.array("slope").alias("slopes"),
        history.alias("objective_history"),
    )


def _moments(names: Sequence[str]) -> list[Column]:
    """Means and the upper triangle of the covariance matrix, as two array columns."""
    pairs = combinations_with_replacement(names, 2)
    return [
        F.array(*(F.avg(name) for name in names)).alias("means"),
        F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("covs"),
    ]


def _square(upper: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from rows that hold their upper triangles."""
    full = np.zeros((len(upper), size, size))
    i, j = np.triu_indices(size)
    full[:, i, j] = upper
    full[:, j, i] = upper
    return full


def _many_features(rows: DataFrame, key: str, features, params: LinearParams) -> DataFrame:
    """One grouped aggregation of all covariances, then one small system per key."""
    names = [*features, "label"]
    sums = rows.groupBy(key).agg(_checked_count(names).alias("n"), *_moments(names))
    size, settings = len(features), params

    @F.pandas_udf("struct<rmse double, r2 double, intercept double, slopes array<double>>")
    def solve(means: pd.Series, covs: pd.Series) -> pd.DataFrame:
        mean = np.array(means.tolist(), dtype=float).reshape(-1, size + 1)
        cov = _square(np.array(covs.tolist(), dtype=float).reshape(len(mean), -1), size + 1)
        return _solve_many(mean, cov, settings)

    iterations, history = _history(params)
    return sums.withColumn("fit", solve("means", "covs")).select(
        key,
        iterations.alias("total_iterations"),
        F.when(F.col("n") > 0, F.col("fit.rmse")).alias("rmse"),
        "fit.r2",
        "fit.intercept",
        "fit.slopes",
        history.alias("objective_history"),
    )


def _solve_many(mean: np.ndarray, cov: np.ndarray, params: LinearParams) -> pd.DataFrame:
    """Penalised least squares for a batch of keys, each given by its means and covariances."""
    size = mean.shape[1] - 1
    mx, my, vy = mean[:, :size], mean[:, size], cov[:, size, size]
    sx = np.sqrt(np.maximum(np.einsum("kii->ki", cov)[:, :size], 0))
    sy = np.sqrt(np.maximum(vy, 0))
    if not params.fit_intercept and params.reg_param > 0 and (sy == 0).any():
        raise ValueError("a key's labels do not vary: no penalty can be scaled without an intercept")
    live = sx > 0
    scale_x, scale_y = np.where(live, sx, 1.0), np.where(sy > 0, sy, 1.0)
    gram, cross = cov[:, :size, :size], cov[:, :size, size]
    if not params.fit_intercept:
        gram = gram + mx[:, :, None] * mx[:, None, :]
        cross = cross + mx * my[:, None]
    gram = gram / (scale_x[:, :, None] * scale_x[:, None, :])
    cross = np.where(live, cross / (scale_x * scale_y[:, None]), 0.0)
    gram = np.where(live[:, :, None] & live[:, None, :], gram, 0.0)

    l1 = np.repeat((params.elastic_net * params.reg_param / scale_y)[:, None], size, axis=1)
    l2 = np.repeat(((1 - params.elastic_net) * params.reg_param / scale_y)[:, None], size, axis=1)
    if not params.standardization:
        l1, l2 = l1 / scale_x, l2 / scale_x**2
    penalised = gram + np.einsum("ki,ij->kij", l2, np.eye(size))
    if params.elastic_net * params.reg_param == 0:
        beta = np.einsum("kij,kj->ki", np.linalg.pinv(penalised, hermitian=True), cross)
    else:
        beta = _descend(penalised, cross, l1)
    beta = np.where(live, beta, 0.0)
    slopes = beta * scale_y[:, None] / scale_x

    intercept = my - (slopes * mx).sum(axis=1) if params.fit_intercept else np.zeros(len(my))
    bias = my - (slopes * mx).sum(axis=1) - intercept
    explained = np.einsum("ki,kij,kj->k", slopes, cov[:, :size, :size], slopes)
    mse = np.maximum(vy - 2 * (slopes * cov[:, :size, size]).sum(axis=1) + explained + bias**2, 0)
    total = vy if params.fit_intercept else vy + my**2
    r2 = [1 - m / t if t > 0 else None for m, t in zip(mse, total)]
    return pd.DataFrame(
        {"rmse": np.sqrt(mse), "r2": r2, "intercept": intercept, "slopes": list(slopes)}
    )


# sweeps of coordinate descent before a key that has not settled is solved by its active sets
_SWEEPS = 200


def _descend(penalised: np.ndarray, cross: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The minima of b'Gb / 2 - c'b + sum(l1 |b|) of a batch of keys, by their covariances.

    Coordinate descent settles most keys in a few sweeps; the others, whose features are almost
    collinear, are solved exactly, key by key.
    """
    beta = np.zeros_like(cross)
    moved = np.ones(len(beta))
    for _ in range(_SWEEPS):
        before = beta.copy()
        for j in range(beta.shape[1]):
            own = penalised[:, j, j]
            rest = cross[:, j] - np.einsum("ki,ki->k", penalised[:, j], beta) + own * beta[:, j]
            shrunk = np.sign(rest) * np.maximum(np.abs(rest) - l1[:, j], 0)
            beta[:, j] = np.divide(shrunk, own, out=np.zeros_like(own), where=own > 0)
        # a step that rounding alone can make counts as none
        moved = np.abs(beta - before).max(axis=1, initial=0) / np.maximum(1, np.abs(beta).max(axis=1, initial=0))
        if (moved < 1e-13).all():
            return beta
    for k in np.flatnonzero(moved >= 1e-13):
        beta[k] = _active_sets(penalised[k], cross[k], l1[k])
    return beta


def _active_sets(gram: np.ndarray, cross: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """A minimum of b'Gb / 2 - c'b + sum(l1 |b|) from active set to active set.

    A feature enters where its gradient exceeds its penalty.  Among the active features the
    minimum for their present signs is solved for directly; on the way there, or along a
    direction in which G is flat, the first feature that would change its sign leaves.  The
    objective falls with each set, so no set comes twice and the search ends.  Where collinear
    features have many minima it gives one of them.
    """
    size = len(cross)
    beta, sign = np.zeros(size), np.zeros(size)
    scale = max(np.abs(cross).max(initial=0), np.abs(l1).max(initial=0), 1e-300)
    for _ in range(50 * (size + 1) ** 2):
        gradient = cross - gram @ beta
        active = np.flatnonzero(sign)
        target = beta.copy()
        if len(active):
            part = gram[np.ix_(active, active)]
            wanted = (cross - l1 * sign)[active]
            target[active] = np.linalg.lstsq(part, wanted, rcond=1e-12)[0]
            flat = wanted - part @ target[active]
            step = target - beta
            unbounded = np.abs(flat).max() > 1e-9 * scale
            if unbounded:  # no minimum for these signs: the objective falls along a flat direction
                step = np.zeros(size)
                step[active] = flat
            turning = active[(sign[active] * step[active] < 0)]
            far = -beta[turning] / step[turning]
            if len(turning) and (unbounded or far.min() <= 1):
                beta = beta + far.min() * step
                leaving = turning[far <= far.min() * (1 + 1e-12)]
                beta[leaving], sign[leaving] = 0.0, 0.0
                continue
            beta = beta + step
            gradient = cross - gram @ beta
        excess = np.where(sign == 0, np.abs(gradient) - l1, -np.inf)
        enters = int(np.argmax(excess))
        if excess[enters] <= 1e-10 * scale or gram[enters, enters] <= 0:
            return beta
        sign[enters] = np.sign(gradient[enters])
    return beta


# --- Huber loss -----------------------------------------------------------------------------
#
# With residual r = y - b - x.w and scale s the mean loss of a key is
#     1/2 * mean(s + r^2/s if |r| <= e*s else s + 2*e*|r| - e^2*s) + 1/2 * reg * |w*sx|^2
# and is convex in (w, b, s) together.  A pass evaluates it and its derivatives at a trial point
# for all keys at once; the update per key is a Newton step, halved while the loss does not fall.


_SLICE, _SLICES = "_slice", 32


def _huber(rows: DataFrame, key: str, features, params: LinearParams) -> DataFrame:
    names, size = [*features, "label"], len(features)
    settings = params
    values = 10 + 5 * size + params.max_iterations
    sums_values = 5 + (size + 2) ** 2
    sums = rows.groupBy(key).agg(_checked_count(names).alias("n"), *_moments(names))
    started = sums.mapInPandas(_starter(size, settings), _state_schema(sums, key))
    open_keys = F.when(~F.col("done"), True)
    state, (keys, left) = checkpoint_counted(started, key, open_keys)
    total = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sliced = keys * values > scale.BROADCAST_VALUES
    rows = spread(rows, total)
    if sliced:
        place = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(_SLICES)).cast("int")
        rows = rows.withColumn(_SLICE, place)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(params.max_iterations):
            if left == 0:
                break
            trials = state.filter(~F.col("done")).select(key, "centers", "scales", "trial")
            if sliced:
                trials = trials.withColumn(_SLICE, F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))))
            else:
                trials = F.broadcast(trials)
            passed = _huber_sums(rows, trials, key, size, params)
            joined = state.join(small(passed, keys, sums_values), key, "left")
            stepped = joined.mapInPandas(_stepper(size, settings), state.schema)
            state, (left,) = checkpoint_counted(stepped, open_keys)
        return _huber_answer(rows.drop(_SLICE), small(state, keys, values), key, size, params)
    finally:
        rows.unpersist()


def _state_schema(sums: DataFrame, key: str) -> str:
    return (
        f"{key} {sums.schema[key].dataType.simpleString()}, n bigint, centers array<double>, "
        "scales array<double>, best array<double>, loss double, step array<double>, "
        "trial array<double>, done boolean, iterations int, history array<double>"
    )


def _starter(size: int, params: LinearParams):
    """First point of each key: least squares on standardised features, centred on the means."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            mean = np.array(pdf["means"].tolist(), dtype=float).reshape(-1, size + 1)
            cov = _square(np.array(pdf["covs"].tolist(), dtype=float).reshape(len(mean), -1), size + 1)
            # the penalty of this loss is scaled by sample deviations
            n = pdf["n"].to_numpy(dtype=float)[:, None]
            scale = np.sqrt(np.maximum(np.einsum("kii->ki", cov), 0) * n / np.maximum(n - 1, 1))
            ridge = LinearParams(
                reg_param=0.0,
                fit_intercept=params.fit_intercept,
                standardization=params.standardization,
            )
            fit = _solve_many(mean, cov, ridge)
            slopes = np.array(fit["slopes"].tolist()).reshape(-1, size)
            sigma = np.maximum(fit["rmse"].to_numpy(), 1e-10 * (1 + np.abs(mean[:, size])))
            center = mean[:, :size] if params.fit_intercept else np.zeros((len(mean), size))
            middle = fit["intercept"].to_numpy() + (slopes * center).sum(axis=1)
            trial = np.column_stack([slopes * scale[:, :size], middle, sigma])
            yield pd.DataFrame(
                {
                    pdf.columns[0]: pdf.iloc[:, 0],
                    "n": pdf["n"],
                    "centers": list(center),
                    "scales": list(scale[:, :size]),
                    "best": [None] * len(pdf),
                    "loss": [None] * len(pdf),
                    "step": [None] * len(pdf),
                    "trial": list(trial),
                    "done": fit["rmse"].to_numpy() <= 1e-10 * (1 + np.abs(mean[:, size])),
                    "iterations": 0,
                    "history": [[] for _ in range(len(pdf))],
                }
            )

    return start


def _huber_sums(rows: DataFrame, trials: DataFrame, key: str, size: int, params) -> DataFrame:
    """Loss terms and derivative sums of every key at its trial point.

    Where the trials carry slices, the rows of a key are dealt over them: each slice joins its
    copy of the trial and is summed apart, so a key with many rows fills no single task.
    """
    by = [name for name in (key, _SLICE) if name in trials.columns]
    features = [name for name in rows.columns if name not in (key, "label", _SLICE)]
    point = F.col("trial")

    def standard(i: int, name: str) -> Column:
        scale = F.get("scales", F.lit(i))
        return F.when(scale > 0, (F.col(name) - F.get("centers", F.lit(i))) / scale).otherwise(0.0)

    scaled = [standard(i, name) for i, name in enumerate(features)]
    joined = rows.join(trials, by).select(
        *by,
        *(column.alias(f"_x{i}") for i, column in enumerate(scaled)),
        "label",
        F.get(point, F.lit(size)).alias("_b"),
        F.get(point, F.lit(size + 1)).alias("_s"),
        *(F.get(point, F.lit(i)).alias(f"_w{i}") for i in range(size)),
    )
    fitted = F.col("_b")
    for i in range(size):
        fitted = fitted + F.col(f"_w{i}") * F.col(f"_x{i}")
    near = F.abs(F.col("_r")) <= params.epsilon * F.col("_s")
    away = joined.withColumn("_r", F.col("label") - fitted).withColumn("_near", near)

    def inside(value: Column) -> Column:
        return F.sum(F.when(F.col("_near"), value).otherwise(0.0))

    def outside(value: Column) -> Column:
        return F.sum(F.when(F.col("_near"), 0.0).otherwise(value))

    r = F.col("_r")
    z = [*(F.col(f"_x{i}") for i in range(size)), F.lit(1.0)]
    pairs = list(combinations_with_replacement(range(size + 1), 2))
    terms = {
        "n_in": [inside(F.lit(1.0))],
        "rr": [inside(r * r)],
        "abs_out": [outside(F.abs(r))],
        "rz": [inside(r * v) for v in z],
        "sz": [outside(F.signum(r) * v) for v in z],
        "zz": [inside(z[i] * z[j]) for i, j in pairs],
    }
    named = {name: [f"{name}{i}" for i in range(len(values))] for name, values in terms.items()}
    flat = [value.alias(f"{name}{i}") for name, values in terms.items() for i, value in enumerate(values)]
    sums = away.groupBy(*by).agg(*flat)
    if len(by) > 1:
        sums = sums.groupBy(key).agg(*(F.sum(name).alias(name) for names in named.values() for name in names))
    single = ("n_in", "rr", "abs_out")
    return sums.select(
        key, *(F.col(names[0]).alias(name) if name in single else F.array(*names).alias(name) for name, names in named.items())
    )


def _stepper(size: int, params: LinearParams):
    """Judge each key's trial point and propose the next one."""
    eps = params.epsilon

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            open_rows = np.flatnonzero(~pdf["done"].to_numpy(dtype=bool))
            state = pdf.drop(columns=["n_in", "rr", "abs_out", "rz", "sz", "zz"])
            if len(open_rows):
                stepped = _steps(pdf.iloc[open_rows])
                for name, values in stepped.items():
                    column = state[name].to_numpy(dtype=object, copy=True)
                    for at, value in zip(open_rows, values):
                        column[at] = value
                    state[name] = pd.Series(column, index=state.index)
            yield state

    def stacked(column: pd.Series, width: int) -> np.ndarray:
        return np.array(column.tolist(), dtype=float).reshape(len(column), width)

    def _steps(pdf: pd.DataFrame) -> dict[str, list]:
        """The new state of open keys, all at once."""
        n, theta, scales = pdf["n"].to_numpy(float), stacked(pdf["trial"], size + 2), stacked(pdf["scales"], size)
        s, w = theta[:, size + 1], theta[:, :size]
        n_in, rr, abs_out = (pdf[name].to_numpy(float) for name in ("n_in", "rr", "abs_out"))
        reg = np.full((len(n), size), params.reg_param)
        if not params.standardization:
            reg = np.divide(reg, scales**2, out=np.zeros_like(reg), where=scales > 0)
        n_out = n - n_in
        loss = (n * s + rr / s + 2 * eps * abs_out - eps**2 * s * n_out) / (2 * n) + 0.5 * (reg * w**2).sum(axis=1)
        earlier = pdf["loss"].to_numpy(float)
        known = ~np.isnan(earlier)
        worse = known & (loss > np.where(known, earlier, np.inf))

        rz, sz = stacked(pdf["rz"], size + 1), stacked(pdf["sz"], size + 1)
        zz = _square(stacked(pdf["zz"], (size + 1) * (size + 2) // 2), size + 1)
        grad = np.empty((len(n), size + 2))
        grad[:, :-1] = -(rz / s[:, None] + eps * sz) / n[:, None]
        grad[:, :size] += reg * w
        grad[:, -1] = (n - rr / s**2 - eps**2 * n_out) / (2 * n)
        hess = np.zeros((len(n), size + 2, size + 2))
        hess[:, :-1, :-1] = zz / (s * n)[:, None, None]
        hess[:, np.arange(size), np.arange(size)] += reg
        hess[:, :-1, -1] = hess[:, -1, :-1] = rz / (s**2 * n)[:, None]
        hess[:, -1, -1] = rr / (s**3 * n)
        free = np.ones((len(n), size + 2), bool)
        free[:, :size], free[:, size] = scales > 0, params.fit_intercept
        hess = np.where(free[:, :, None] & free[:, None, :], hess, 0.0)
        # a smallest solution, by singular values: a parameter that is not free does not move
        move = -np.einsum("kij,kj->ki", np.linalg.pinv(hess, rcond=1e-13), np.where(free, grad, 0.0))
        short = s + move[:, -1] < 0.1 * s
        move[short] *= (0.9 * s[short] / -move[short, -1])[:, None]
        gained = known & ~worse & (earlier - loss <= params.tolerance * np.maximum(np.abs(loss), 1e-12))

        # where the step was too long: stay at the best point and try half of it
        zeros = np.zeros(size + 2)
        best = np.array([theta[k] if not worse[k] else np.asarray(b, float) for k, b in enumerate(pdf["best"])]).reshape(len(n), -1)
        half = np.array([zeros if not worse[k] else np.asarray(m, float) / 2 for k, m in enumerate(pdf["step"])]).reshape(len(n), -1)
        stuck = worse & (np.abs(half).max(axis=1) <= 1e-12 * (1 + np.abs(best).max(axis=1)))
        move = np.where(worse[:, None], half, move)
        return {
            "best": list(best),
            "loss": np.where(worse, earlier, loss).tolist(),
            "step": list(move),
            "trial": list(best + move),
            "done": (stuck | gained).tolist(),
            "iterations": (pdf["iterations"].to_numpy() + (known & ~worse)).tolist(),
            "history": [h if w else [*h, v] for h, v, w in zip(pdf["history"], loss.tolist(), worse)],
        }

    return step


def _huber_answer(rows: DataFrame, state: DataFrame, key: str, size: int, params) -> DataFrame:
    """Unscaled coefficients and the training metrics at the best point of each key."""
    features = [name for name in rows.columns if name not in (key, "label")]
    point = F.coalesce("best", "trial")

    def slope(i: int) -> Column:
        scale = F.get("scales", F.lit(i))
        return F.when(scale > 0, F.get(point, F.lit(i)) / scale).otherwise(0.0)

    intercept = F.get(point, F.lit(size))
    for i in range(size):
        intercept = intercept - slope(i) * F.get("centers", F.lit(i))
    models = state.select(
        key,
        F.col("iterations").alias("total_iterations"),
        intercept.alias("intercept"),
        F.array(*(slope(i) for i in range(size))).alias("slopes"),
        F.col("history").alias("objective_history"),
        F.get(point, F.lit(size + 1)).alias("scale"),
    )
    fitted = F.col("intercept")
    for i, name in enumerate(features):
        fitted = fitted + F.get("slopes", F.lit(i)) * F.col(name)
    error = F.col("label") - fitted
    total = F.count("label") * F.var_pop("label")
    if not params.fit_intercept:
        total = F.sum(F.col("label") * F.col("label"))
    metrics = (
        rows.join(models, key)
        .groupBy(key)
        .agg(F.count("label").alias("_n"), F.sum(error * error).alias("_sse"), total.alias("_sst"))
    )
    answer = models.join(metrics, key).select(
        key,
        "total_iterations",
        F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"),
        r2_column(F.col("_sse"), F.col("_sst")).alias("r2"),
        "intercept",
        "slopes",
        "objective_history",
        "scale",
    )
    return checkpoint(answer)
