"""Profile, project and cluster an encoded table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage import vocab
from sondage.operators import cluster, metrics, profile
from sondage.operators.relate import attach
from sondage.operators.schema import drop_if_present, ref
from sondage.session import cut_lineage
from sondage.sources.tables import write_analysis, write_pca, write_table


@dataclass
class Exploration:
    """Every table of an exploration run, as DataFrames."""

    univariate: DataFrame
    heat: DataFrame
    lines: DataFrame
    target: DataFrame
    scree: DataFrame
    loadings: DataFrame
    projected: DataFrame
    kmeans: DataFrame
    clustered: DataFrame
    summary: DataFrame
    analysis: tuple[DataFrame, DataFrame, DataFrame]
    profiles: DataFrame
    best: int

    def write(self, folder: str, fmt: str = "parquet") -> None:
        write_pca(self.loadings, self.projected, f"{folder}/pca", fmt)
        write_analysis(*self.analysis, f"{folder}/clustering", fmt)
        tables = {
            "univariate": self.univariate, "bivariate_heat": self.heat, "bivariate_lines": self.lines, "vs_target": self.target, "scree": self.scree,
            "kmeans_range": self.kmeans, "clustering_summary": self.summary, "cluster_comparison_means": self.profiles,
            "dataset_with_kmeans_clusters": self.clustered.drop("cluster_gmm", "cluster_confidence"),
            "dataset_with_gmm_clusters": self.clustered.drop("cluster_kmeans"),
        }
        for name, table in tables.items():
            write_table(table, f"{folder}/{name}", fmt)


def explore(df: DataFrame, row_id: str = "respondent_id", target: str = "Risk_Score", ks=range(2, 11), n_init: int = 10) -> Exploration:
    """Group profiles, PCA, k-means over a range of k, a mixture with the best k, and their comparison.

    Rows with gaps have no components and no cluster; they keep NULL labels.
    """
    df = cut_lineage(drop_if_present(df, [*vocab.AUXILIARY, vocab.TARGET]))
    heat, lines = profile.bivariate(df)
    fit = cluster.fit_pca(df, target=target, row_id=row_id)
    names = [f"PC{i + 1}" for i in range(fit.components)]
    projected = cut_lineage(cluster.project_pca(df, fit).select(ref(row_id), *names))
    table = cluster.loadings(df, fit)
    found = cluster.kmeans_range(projected, names, row_id, ks, n_init)
    mixture = cluster.gmm(projected, names, found.best, row_id)
    labels = found.labelled.select(ref(row_id), F.col(f"k{found.best}").alias("cluster_kmeans"))
    labels = labels.join(mixture.labelled.select(ref(row_id), "cluster_gmm", "cluster_confidence"), row_id)
    clustered = cut_lineage(attach(df, labels, row_id))
    ari = metrics.adjusted_rand(clustered, "cluster_kmeans", "cluster_gmm").first()[0]
    agreed = metrics.agreement(clustered, "cluster_kmeans", "cluster_gmm").first()[0]
    score = found.table.filter(F.col("k") == found.best).first()["silhouette"]
    return Exploration(
        profile.univariate(df), heat, lines, profile.target_profile(df, target, row_id=row_id), cluster.scree_rows(df, fit), table, projected, found.table, clustered,
        cluster.clustering_summary(df, found.best, score, mixture, ari, agreed), profile.risk_score_analysis(clustered, clustered, target),
        profile.cluster_profiles(clustered, fit.features), found.best,
    )
