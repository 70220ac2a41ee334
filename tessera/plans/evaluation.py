"""Experiments: features and responses in, cross-validated predictions and reports out."""

from __future__ import annotations

from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..operators import clustering, crossval, features, forests, regression, statistics, vectors
from ..operators.alignment import alignment_distances
from ..sources import structures, tables
from ..store import keep
from .options import Options

#: Feature numbers up to which all tasks share one broadcast copy.
SHARED = 20_000_000


# -- filters of measurements ---------------------------------------------------


def filter_affinity(rows: DataFrame, options: Options) -> DataFrame:
    """Measurements of wanted types, years and values; bounds are of concentrations."""
    out = rows.where(~F.col("affinity_type").isin(*options.ignore_types)) if options.ignore_types else rows
    out = out.where(F.col("year").between(*options.years))
    if options.least_value > 0:
        out = out.where(F.col("value") >= F.ln(F.lit(options.least_value)))
    if options.most_value < 1:
        out = out.where(F.col("value") <= F.ln(F.lit(options.most_value)))
    return out


def smallest(rows: DataFrame) -> DataFrame:
    """One measurement of each accession: that of the smallest value."""
    w = Window.partitionBy("accession").orderBy("value", "affinity_match", "year")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def restrict(rows: DataFrame, key: str, *others: tuple[DataFrame | None, str]) -> tuple[DataFrame, DataFrame]:
    """`rows` with a partner in every table given, and the rejects."""
    kept = rows
    for other, name in others:
        if other is not None:
            kept = kept.join(other.select(F.col(name).alias(key)).distinct(), key, "left_semi")
    return kept, rows.join(kept.select(key).distinct(), key, "left_anti")


def counts(rows: DataFrame) -> DataFrame:
    """(property, value, n) of affinity and structure types."""
    parts = [rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("property"), "value", "n") for c in ("affinity_type", "structure_type")]
    return parts[0].unionByName(parts[1])


# -- cross-validation -----------------------------------------------------------


def cross_validate(members: DataFrame, rows: DataFrame, options: Options, model: str | None = None, fitted: bool = True) -> DataFrame:
    """(clustering_id, trial, fold, cluster, complex_id, observed, predicted, training).

    members: (clustering_id, cluster_id, complex_id); rows: (complex_id, features,
    response), one for each complex; a member without one fails. A task is a clustering,
    trial and fold: it trains on the other folds and predicts its own; rows with
    `training` hold what it fits to its training rows, none without `fitted`.
    """
    model = model or options.model
    tasks, few = _dealt(members, rows, options)
    if few:
        return _within_tasks(tasks, rows, options, model, fitted)
    return _over_tables(tasks, rows, options, model, fitted)


def neighbour_fits(members: DataFrame, rows: DataFrame, options: Options, counts: list[int], fitted: bool = True) -> list[DataFrame]:
    """`cross_validate` by each of several numbers of nearest neighbours. Vectors of large
    tables meet once for all of them, as the nearest few are the first of the nearest many."""
    tasks, few = _dealt(members, rows, options)
    if few:
        return [keep(_within_tasks(tasks, rows, replace(options, neighbours=k), "nn", fitted)) for k in counts]
    found = keep(_neighbour_guesses(tasks, rows, options, fitted, counts))
    return [found.select(*found.columns[:6], F.col(f"predicted_{k}").alias("predicted"), "training") for k in counts]


def _dealt(members: DataFrame, rows: DataFrame, options: Options) -> tuple[DataFrame, bool]:
    """Members with what was observed, their fold and each task, and whether a task can hold
    all their rows."""
    lost = members.join(rows, "complex_id", "left_anti").select("complex_id").first()
    if lost:
        raise ValueError(f"no features of {lost['complex_id']}")
    known = crossval.training_weights(members, options.equal_clusters_in_training).join(rows.select("complex_id", F.col("response").cast("double").alias("observed")), "complex_id")
    dealt = known.join(crossval.folds(members, options.trials, options.fold, options.seed), ["clustering_id", "cluster_id"])
    tasks = dealt.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(options.fold - 1))))
    width, n = rows.agg(F.max(F.size("features")), F.count("*")).first()
    return tasks, n <= forests.MOST and (width or 0) * n <= SHARED


def _neighbour_guesses(tasks: DataFrame, rows: DataFrame, options: Options, fitted: bool, counts: list[int]) -> DataFrame:
    """`cross_validate` by nearest neighbours, with a column `predicted_<k>` for each k of
    `counts`: vectors meet once for all clusterings, trials and folds, whose numbers go with
    them; what a model leaves out is a fold."""
    c = F.col
    own = keep(tasks.where("fold = task").select("clustering_id", "trial", "fold", c("cluster_id").alias("cluster"), c("complex_id").alias("id"), "observed"))
    found = sorted(tuple(r) for r in own.select("clustering_id", "trial").distinct().collect())  # a row for each trial of a clustering
    runs = rows.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found)], "clustering_id int, trial int, run int")
    folds = own.join(F.broadcast(runs), ["clustering_id", "trial"])
    spots = F.map_from_entries(F.collect_list(F.struct("run", c("fold").cast("int"))))
    marks = folds.groupBy("id").agg(spots.alias("at"), F.first("observed").alias("value")).select("id", "value", F.transform(F.sequence(F.lit(0), F.lit(max(0, len(found) - 1))), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(-1))).alias("marks"))
    kind = vectors.vector_kind(rows.schema["features"].dataType.simpleString())
    have = keep(marks.join(rows.select(c("complex_id").alias("id"), c("features").cast(kind).alias("v")), "id"))
    asked = have.select(F.lit("").alias("label"), "id", "v", "marks")
    if fitted:  # with each fold left out, its own among them
        asked = have.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(options.fold - 1))))
        asked = asked.select(c("task").cast("string").alias("label"), "id", "v", F.transform("marks", lambda m: F.when(m < 0, m).otherwise(c("task"))).alias("marks"))
    near = vectors.nearest_in_blocks(asked, have.select("id", "v", "value", "marks"), max(counts), True, max(1, len(found)))
    guesses = near.groupBy("label", "id", "run").agg(*[F.avg(F.when(c("rank") <= k, c("value"))).alias(f"predicted_{k}") for k in counts])
    met = folds.join(guesses, ["id", "run"])
    task = c("label").cast("int") if fitted else c("fold")
    return met.select("clustering_id", "trial", task.cast("int").alias("fold"), "cluster", c("id").alias("complex_id"), "observed", *[f"predicted_{k}" for k in counts], (task != c("fold")).alias("training"))


def _over_tables(tasks: DataFrame, rows: DataFrame, options: Options, model: str, fitted: bool) -> DataFrame:
    """`cross_validate` of tables of any size: no task holds the rows of a model."""
    c = F.col
    if model == "nn":
        return _neighbour_guesses(tasks, rows, options, fitted, [options.neighbours]).withColumnRenamed(f"predicted_{options.neighbours}", "predicted")
    if model != "forest":
        return _linear_fits(tasks, rows, options.fold, fitted)
    name = F.concat_ws(":", "clustering_id", "trial", "task")
    named = keep(tasks.select(name.alias("model"), "clustering_id", "trial", "task", "fold", "cluster_id", c("complex_id").alias("id"), "observed", F.when(c("fold") != c("task"), c("w")).alias("w"), c("cluster_id").alias("cluster")))
    table = rows.select(c("complex_id").alias("id"), "features", "response")
    guesses = forests.predictions(table, named.select("model", "id", "w", "cluster"), options.forest, forests.GROWN * forests.MOST, fitted)
    met = named.join(guesses, ["model", "id"])
    return met.select("clustering_id", "trial", c("task").alias("fold"), "cluster", c("id").alias("complex_id"), "observed", "predicted", c("w").isNotNull().alias("training")).where(F.lit(fitted) | ~c("training"))


#: Rows that a task of linear fits takes, about.
LINEAR = 100_000


def _linear_fits(tasks: DataFrame, rows: DataFrame, fold: int, fitted: bool) -> DataFrame:
    """`cross_validate` by least squares: every fold of a clustering and trial becomes one
    factor, and a model is fitted to those of the other folds, so a row is written once for
    each trial of a clustering, with its features, and meets its models where it lies.
    Factors are as large as the square of the features, not the rows."""
    c = F.col
    width, n = rows.agg(F.max(F.size("features")), F.count("*")).first()
    runs = ["clustering_id", "trial"]
    # Each row is in one fold of a run; the task after that one trains on it (itself, if there is but one).
    own = tasks.where(c("task") == F.pmod(c("fold") + 1, F.lit(fold))).select(*runs, "fold", c("cluster_id").alias("cluster"), "complex_id", "observed", F.when(c("fold") != c("task"), c("w")).alias("w"))
    own = keep(vectors.spread(own.join(rows.select("complex_id", "features"), "complex_id"), n, LINEAR))
    group = F.concat_ws(":", *runs, "fold")
    found = regression.factors(own.where("w IS NOT NULL").select(*regression.weighted_rows(group, c("features"), c("observed"), c("w"))), (width or 0) + 1)
    parts = F.split("g", ":")
    other = found.select(*(parts[i].cast("int").alias(n) for i, n in enumerate((*runs, "fold"))), "v", F.explode(F.sequence(F.lit(0), F.lit(fold - 1))).alias("task")).where("fold <> task")

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"clustering_id": [int(key[0])], "trial": [int(key[1])], "task": [int(key[2])], "line": [regression.solve(np.stack(part["v"].to_numpy())).tolist()]})

    lines = keep(other.groupBy(*runs, "task").applyInPandas(fit, "clustering_id int, trial int, task int, line array<double>"))
    if not fitted:
        lines = lines.withColumn("fold", c("task"))
    met = own.join(lines, runs if fitted else [*runs, "fold"])
    return met.select(*runs, c("task").alias("fold"), "cluster", "complex_id", "observed", vectors.dot(c("line"), c("features")).alias("predicted"), (c("task") != c("fold")).alias("training"))


def _within_tasks(tasks: DataFrame, rows: DataFrame, options: Options, model: str, fitted: bool) -> DataFrame:
    """`cross_validate` of tables that a task can hold, up to `forests.MOST` rows: their
    features are broadcast once, and a clustering, trial and fold is a group."""
    # At most SHARED numbers.
    table = rows.select("complex_id", F.col("features").cast("array<double>").alias("features")).toArrow()
    flat = table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shared = rows.sparkSession.sparkContext.broadcast(({c: i for i, c in enumerate(table.column("complex_id").to_pylist())}, flat.reshape(table.num_rows, -1)))
    kind = rows.schema["complex_id"].dataType.simpleString()

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values("complex_id", kind="stable")
        at, matrix = shared.value
        x = matrix[[at[c] for c in task["complex_id"]]]
        y, w = task["observed"].to_numpy(), task["w"].to_numpy()
        test = (task["fold"] == task["task"]).to_numpy()
        if model == "forest":
            name = ":".join(str(int(task[c].iloc[0])) for c in ("clustering_id", "trial", "task"))
            ids = task["complex_id"].to_numpy()[~test].tolist()
            guess = regression.predict(regression.build_forest(x[~test], y[~test], w[~test], options.forest, name, ids, task["cluster_id"].to_numpy()[~test]), x)
        elif model == "nn":
            guess = regression.nearest_mean(x, x[~test], y[~test], options.neighbours)
        else:
            guess = x @ regression.least_squares(x[~test], y[~test], w[~test])
        out = pd.DataFrame({"clustering_id": task["clustering_id"], "trial": task["trial"], "fold": task["task"], "cluster": task["cluster_id"], "complex_id": task["complex_id"], "observed": y, "predicted": guess, "training": ~test})
        return out if fitted else out[test]

    return tasks.groupBy("clustering_id", "trial", "task").applyInPandas(run, f"clustering_id int, trial int, fold int, cluster int, complex_id {kind}, observed double, predicted double, training boolean")


def trial_statistics(predictions: DataFrame, equal_clusters: bool = False) -> DataFrame:
    """(clustering_id, trial, n, pearson, rmse, r2) of what each trial predicted."""
    return statistics.statistics(predictions.where("not training"), ["clustering_id", "trial"], equal_clusters)


#: Names of the report's columns, by the statistic they hold.
R, P, RMSE, R2 = ("{ave}{name}_r", "stdev_{name}_r"), "{name}_p_value", ("{ave}{name}_RMSE", "stdev_{name}_RMSE"), ("{ave}{name}_R2", "stdev_{name}_R2")


def model_columns(rows: DataFrame, name: str, options: Options, errors: bool = True) -> DataFrame:
    """(clustering_id, columns): mean and deviation over trials of Pearson's r, RMSE and R2,
    and the mean p-value; of one trial, the values and no p. Without `errors`, r only."""
    test = rows.where("not training")
    each = trial_statistics(rows, options.equal_clusters)
    cols = lambda c, names: [F.avg(c).alias(names[0].format(ave="ave_", name=name)), *([F.stddev_pop(c).alias(names[1].format(name=name))] if options.trials > 1 else [])]
    out = each.groupBy("clustering_id").agg(*cols("pearson", R))
    if options.trials > 1:
        p = statistics.permutation_p(test, options.permutations, options.seed, ["clustering_id", "trial"], options.equal_clusters)
        out = out.join(p.groupBy("clustering_id").agg(F.avg("p").alias(P.format(name=name))), "clustering_id")
    if errors:
        out = out.join(each.groupBy("clustering_id").agg(*cols("rmse", RMSE), *cols("r2", R2)), "clustering_id")
    return out


def report(members: DataFrame, model: DataFrame, baseline: DataFrame, options: Options, beside: dict[str, DataFrame] | None = None) -> DataFrame:
    """The statistics of each clustering that was evaluated, of the baseline, of the models
    beside and of the model: 18 columns and 3 for each model beside (of one trial 9, and
    one each). min_cluster_distance is null for clusterings that have none."""
    low = F.min("min_dist") if "min_dist" in members.columns else F.lit(None).cast("double")
    out = members.groupBy("clustering_id").agg(low.alias("min_cluster_distance"), F.countDistinct("cluster_id").alias("number_of_clusters"))
    out = out.join(model_columns(baseline, "baseline", options), "clustering_id")
    for name, rows in (beside or {}).items():
        out = out.join(model_columns(rows, name, options, errors=False), "clustering_id")
    out = out.join(model_columns(model, "model", options), "clustering_id")
    test = lambda df, p: statistics.weighted(df.where("not training"), ["clustering_id", "trial"], options.equal_clusters).select("clustering_id", "trial", "complex_id", "observed", "w", F.col("predicted").alias(p))
    both = test(model, "m").join(test(baseline, "b").drop("observed", "w"), ["clustering_id", "trial", "complex_id"])
    err = lambda p: F.sum(F.col("w") * (F.col("observed") - F.col(p)) * (F.col("observed") - F.col(p)))
    r2 = both.groupBy("clustering_id", "trial").agg((1 - F.try_divide(err("m"), err("b"))).alias("r2")).groupBy("clustering_id")
    r2 = r2.agg(F.avg("r2").alias("ave_model_R2(baseline)"), *([F.stddev_pop("r2").alias("stdev_model_R2(baseline)")] if options.trials > 1 else []))
    return out.join(r2, "clustering_id").orderBy("clustering_id").drop("clustering_id")


def preamble(spark: SparkSession, options: Options, counted: DataFrame | None) -> DataFrame:
    """(key, value): the options of an experiment, and counts of its measurements."""
    flat = {f"{k}.{j}" if isinstance(v, dict) else k: u for k, v in asdict(options).items() for j, u in (v.items() if isinstance(v, dict) else [("", v)])}
    out = spark.createDataFrame([(k, str(v)) for k, v in flat.items()], "key string, value string")
    return out if counted is None else out.unionByName(counted.select(F.concat_ws(".", "property", "value").alias("key"), F.col("n").cast("string").alias("value")))


def per_complex(predictions: DataFrame) -> DataFrame:
    """(complex_id, observed, mean, sd) over trials and clusterings."""
    test = predictions.where("not training")
    return test.groupBy("complex_id").agg(F.first("observed").alias("observed"), F.avg("predicted").alias("mean"), F.stddev_pop("predicted").alias("sd"))


# -- whole experiments ------------------------------------------------------------


def points_of(atoms: DataFrame) -> DataFrame:
    return atoms.select(F.col("complex_id").alias("complex"), "side", F.col("atom_type").alias("type"), "x", "y", "z", "serial", "res_no", "res_type")


def residues_of(atoms: DataFrame) -> DataFrame:
    return atoms.select(F.col("complex_id").alias("complex"), "side", "res_no", F.col("res_type").alias("type")).distinct()


def composition_vectors(atoms: DataFrame) -> DataFrame:
    """(complex_id, features): residue counts, and the zero that fills the width."""
    table = features.composition(residues_of(atoms))
    names = [c for c in table.columns if c != "complex"]
    return table.select(F.col("complex").alias("complex_id"), F.array(*[F.col(c).cast("double") for c in names], F.lit(0.0)).alias("features"))


def structure_vectors(atoms: DataFrame, options: Options) -> DataFrame:
    """(complex_id, features): the options' structural feature as one vector, zeros for
    complexes without any of it."""
    points = points_of(atoms)
    found = feature_vectors(points, atoms, options).withColumnRenamed("complex", "complex_id")
    width = found.select(F.max(F.size("features"))).first()[0] or 0
    every = points.select(F.col("complex").alias("complex_id")).distinct()
    return every.join(found, "complex_id", "left").withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0.0), width)))


def feature_vectors(points: DataFrame, atoms: DataFrame, options: Options) -> DataFrame:
    """(complex, features) of the feature that the options name."""
    o, name = options, options.feature
    residues = residues_of(atoms)
    typed = points.withColumn("type", F.col("res_type"))
    pair = ["type_a", "type_b"]
    if name.startswith("distance_histogram"):
        types = [r["type"] for r in points.select("type").distinct().collect()]  # element names
        edges = {"distance_histogram_geometric": features.geometric_edges, "distance_histogram_log": features.log_edges}.get(name)
        histogram = features.distance_histogram(points, o.low, o.high, o.bins, edges(o.low, o.high, o.bins) if edges else None)
        return features.self_histogram_features(histogram, types, o.bins)
    if name == "composition":
        return composition_vectors(atoms).withColumnRenamed("complex_id", "complex")
    if name == "minimum_distance":
        long = features.long_form(features.minimum_distance_histogram(points, o.low, o.high, o.bins), ["type", "bin"], ["n"])
    elif name == "adjacent_pairs":
        long = features.long_form(features.adjacent_pairs(residues, ["side", "res_no", "type"]), ["first", "second"], ["n"])
    elif name == "adjacency":
        table = features.adjacency(points, o.self_reach, o.other_reach, o.self_most, o.other_most)
        long = features.long_form(table.withColumnsRenamed({"self_n": "self_bin", "other_n": "other_bin"}), ["type", "self_bin", "other_bin"], ["n"])
    elif name == "distance_sums":
        long = features.long_form(features.distance_sums(points, o.high), pair, ["inverse", "inverse_square"])
    elif name == "power_sums":
        long = features.long_form(features.power_sums(points, o.high), pair, [f"sum_{k}" for k in range(4)])
    elif name == "contact_weights":
        long = features.long_form(features.contact_weights(typed, o.other_reach, o.high), pair, ["weight"])
    elif name == "residue_contacts":
        long = features.long_form(features.residue_contacts(typed, o.other_reach), pair, ["n"])
    else:
        table = features.hydrogen_bonds(features.hydrogen_triples(points))
        long = features.long_form(table, ["donor_type", "acceptor_type", "angle_bin", "distance_bin"], ["n"])
    return features.as_vectors(long)


def build_clusters(atoms: DataFrame, options: Options) -> DataFrame:
    """Single linkage of complexes by composition or by alignment."""
    if options.cluster_by == "alignment":
        d = alignment_distances(structures.sequences(atoms))
    else:
        d = vectors.distance_matrix(composition_vectors(atoms), "complex_id", "features")
    return clustering.single_linkage(d, options.fold)


def external_scores(spark: SparkSession, options: Options) -> tuple[DataFrame | None, bool]:
    found = [f(spark, p) for f, p in ((tables.read_scores, options.scores or options.only_scores), (tables.read_score_report, options.score_report or options.only_score_report)) if p]
    if len(found) == 2:
        both = found[0].join(found[1].withColumnRenamed("scores", "more"), "complex_id").select("complex_id", F.concat("scores", "more").alias("scores"))
        return both, bool(options.only_scores or options.only_score_report)
    return (found[0] if found else None), bool(options.only_scores or options.only_score_report)


def run(spark: SparkSession, options: Options) -> dict[str, DataFrame]:
    """The tables of an experiment: rejected files, inventory, clusters, predictions of
    baseline and model, and the two report tables; written to `output` if it is set."""
    if not options.structures or not (options.affinity or options.random_affinity or options.surrogate_affinity):
        raise ValueError("structures are needed, and affinity unless a control stands for it")
    read = keep(structures.read_structures(spark, options.structures, options.reading))
    atoms = structures.usable(read)
    if options.without_type:
        atoms = atoms.where(F.col("atom_type") != options.without_type)
    out = {"rejected": structures.rejected(read), "inventory": features.inventory(points_of(atoms))}
    if options.histograms:
        histogram = features.distance_histogram(points_of(atoms), options.low, options.high, options.bins)
        sinks.write_histograms(histogram, options.bins, options.histograms)
    scores, only = external_scores(spark, options)
    if options.affinity:
        measured = filter_affinity(smallest(tables.read_affinity(spark, options.affinity)), options)
        measured, out["unmatched"] = restrict(measured, "accession", (atoms, "complex_id"), (scores, "complex_id"))
        out["counts"] = counts(measured)
        response = measured.select(F.col("accession").alias("complex_id"), F.col("value").alias("response"))
    elif options.surrogate_affinity:
        response = features.surrogate_score(points_of(atoms), options.high, options.seed).select(F.col("complex").alias("complex_id"), F.col("score").alias("response"))
    else:
        response = None
    if options.cluster_by:
        usable = atoms.join(response, "complex_id", "left_semi") if response is not None else atoms
        members = build_clusters(usable, options)
        if options.clusters:
            sinks.write_clusters(members, options.clusters)
    elif options.clusters:
        members = tables.read_clusters(spark, options.clusters)
    else:
        raise ValueError("a cluster file is needed, or a way to build one")
    members = keep(clustering.keep_measured(members, atoms))
    if response is None:
        response = crossval.random_affinity(members, options.seed).withColumnRenamed("value", "response")
    members = keep(clustering.keep_measured(members, response))
    structural = structure_vectors(atoms, options)
    if scores is not None:
        structural = vectors.append_scores(structural, scores, "complex_id", only)
    rows = keep(structural.join(response, "complex_id"))
    base = keep(composition_vectors(atoms).join(response, "complex_id"))
    baseline = keep(cross_validate(members, base, options, "forest"))
    fits = {}
    for kind in dict.fromkeys((options.model, *options.beside)):
        # Least squares fits power sums, as sums of pairwise terms.
        table = keep(structure_vectors(atoms, replace(options, feature="power_sums")).join(response, "complex_id")) if kind == "linear" and not only else rows
        fits[kind] = keep(cross_validate(members, table, options, kind))
    model = fits[options.model]
    beside = {kind: fits[kind] for kind in ("linear", "nn") if kind in options.beside}
    out |= {"clusters": members, "baseline": baseline, "model": model, "beside": beside, "statistics": report(members, model, baseline, options, beside), "complexes": per_complex(model)}
    out["preamble"] = preamble(spark, options, out.get("counts"))
    if options.output:
        for name in ("preamble", "statistics", "complexes"):
            sinks.write_report(out[name], f"{options.output}/{name}")
    return out
