"""Keyword taxonomies as data, and the column expressions made from them.

A keyword hits as a substring of lower-cased text. Expressions use higher-order functions
over literal arrays, so a taxonomy of any size stays one small projection per group.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Taxonomy:
    """Ordered groups of keywords; order breaks ties."""

    groups: dict[str, list[str]]
    descriptions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str) -> Taxonomy:
        """From a file {group: {"description": ..., "keywords": [...]}} or {group: [...]}, in its order."""
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        words = {g: v["keywords"] if isinstance(v, dict) else v for g, v in raw.items()}
        return cls(words, {g: v.get("description", "") for g, v in raw.items() if isinstance(v, dict)})

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, g, self.descriptions.get(g, ""), j, k) for i, (g, kws) in enumerate(self.groups.items()) for j, k in enumerate(kws)]
        return spark.createDataFrame(rows, "grp_ord int, grp string, description string, kw_ord int, kw string")

    def order(self, spark: SparkSession) -> DataFrame:
        rows = [(g, i, self.descriptions.get(g, "")) for i, g in enumerate(self.groups)]
        return spark.createDataFrame(rows, "category string, grp_ord int, description string")


def _words(keywords: list[str]) -> Column:
    return F.array(*map(F.lit, keywords))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def group_scores(text: Column, taxonomy: Taxonomy) -> Column:
    """Array of (minus score, order, group): the number of a group's different keywords in the text."""
    return F.array(
        *(
            F.struct((-F.size(F.filter(_words(kws), lambda k: F.contains(text, k)))).alias("less"), F.lit(i).alias("ord"), F.lit(g).alias("grp"))
            for i, (g, kws) in enumerate(taxonomy.groups.items())
        )
    )


def categories(text: Column, taxonomy: Taxonomy, most: int = 3, other: str = "Other") -> Column:
    """The best groups by score, ties in taxonomy order; `other` without a hit."""

    def names(best: Column) -> Column:
        return F.when(F.size(best) == 0, F.array(F.lit(other))).otherwise(F.transform(best, lambda s: s["grp"]))

    return bound(text, lambda x: bound(F.slice(F.array_sort(F.filter(group_scores(x, taxonomy), lambda s: s["less"] < 0)), 1, most), names))


def groups_hit(text: Column, taxonomy: Taxonomy) -> Column:
    """All groups with a keyword in the text, in taxonomy order."""
    return bound(text, lambda x: F.array_compact(F.array(*(F.when(F.exists(_words(kws), lambda k: F.contains(x, k)), F.lit(g)) for g, kws in taxonomy.groups.items()))))


def relevance(text: Column, methods: Taxonomy) -> Column:
    """Points for method groups, learning terms and domain terms, added one by one in that order, at most 1."""

    def points(x: Column) -> Column:
        hits = lambda terms: F.size(F.filter(_words(terms), lambda k: F.contains(x, k)))
        return F.concat(
            F.array_repeat(F.lit(0.15), F.size(groups_hit(x, methods))),
            F.array_repeat(F.lit(0.05), hits(LEARNING_TERMS)),
            F.array_repeat(F.lit(0.1), F.when(hits(DOMAIN_TERMS) >= 2, 1).otherwise(0)),
        )

    return F.least(F.lit(1.0), F.aggregate(bound(text, points), F.lit(0.0), lambda a, x: a + x))


# The method groups, the tools, and the terms of the relevance score.
METHODS = Taxonomy(
    {
        "CNN": ["cnn", "convolutional neural network", "convolutional network", "conv2d", "resnet", "u-net", "unet", "vgg", "inception"],
        "Transformer": ["transformer", "self-attention", "multi-head attention", "attention mechanism", "vision transformer", "vit"],
        "GNN": ["graph neural network", "gnn", "graph convolutional", "gcn", "graph attention", "gat", "message passing"],
        "GAN": ["generative adversarial", "gan", "discriminator", "generator network", "adversarial training", "wgan", "cyclegan", "pix2pix"],
        "Autoencoder": ["autoencoder", "vae", "variational autoencoder", "encoder-decoder", "latent space", "reconstruction loss"],
        "Diffusion Model": ["diffusion model", "denoising diffusion", "ddpm", "score-based", "diffusion process"],
        "RNN/LSTM": ["recurrent neural network", "rnn", "lstm", "long short-term memory", "gru", "bidirectional lstm", "bi-lstm"],
        "Foundation Model": ["foundation model", "pre-trained model", "pretrained model", "large language model", "llm", "bert", "gpt", "large-scale pre-training"],
        "Reinforcement Learning": ["reinforcement learning", "reward function", "policy gradient", "q-learning", "rl agent"],
        "Random Forest / XGBoost": ["random forest", "xgboost", "gradient boosting", "decision tree", "ensemble method", "lightgbm"],
        "SVM / Classical ML": ["support vector machine", "svm", "logistic regression", "naive bayes", "k-nearest neighbor", "knn"],
        "Transfer Learning": ["transfer learning", "domain adaptation", "fine-tuning", "fine-tune", "pre-training and fine-tuning"],
        "Contrastive Learning": ["contrastive learning", "self-supervised", "siamese network", "triplet loss", "contrastive loss", "simclr", "byol"],
        "Sequence Model": ["sequence model", "seq2seq", "sequence-to-sequence", "dna sequence model", "nucleotide-level", "base-pair resolution"],
    }
)
TOOLS = Taxonomy(
    {
        "Akita": ["akita"],
        "Enformer": ["enformer"],
        "DeepHiC": ["deephic"],
        "HiCPlus": ["hicplus", "hic-plus"],
        "HiCSR": ["hicsr", "hic-sr"],
        "HiCNN": ["hicnn"],
        "Orca": ["orca model", "orca predicts"],
        "Sei": ["sei framework", "sei model"],
        "Basenji": ["basenji"],
        "DeepLoop": ["deeploop"],
        "Peakachu": ["peakachu"],
        "DeepTAD": ["deeptad"],
        "HiCGAN": ["hicgan"],
        "scHiCluster": ["shicluster", "schic cluster"],
        "Higashi": ["higashi"],
        "SnapHiC": ["snaphic"],
        "Dip-C": ["dip-c"],
        "DeepC": ["deepc"],
        "EPCOT": ["epcot"],
        "ChromaFold": ["chromafold"],
        "C.Origami": ["c.origami", "origami model"],
        "HiCFoundation": ["hicfoundation"],
        "HiCDiffusion": ["hicdiffusion"],
    }
)
LEARNING_TERMS = ["deep learning", "neural network", "machine learning", "training", "loss function", "epoch", "batch", "prediction", "classification", "regression", "model architecture", "hyperparameter"]
DOMAIN_TERMS = ["hi-c", "chromatin", "genome", "tad", "loop", "contact map", "chromosome", "3d structure"]

#: A taxonomy for tests, of word parts that synthetic prose holds.
FIXTURE = Taxonomy(
    {
        "fx_articles": ["the ", "der ", "les ", "los "],
        "fx_suffix_en": ["tion", "ing", "ble"],
        "fx_suffix_fr": ["ment", "eau", "elle"],
        "fx_de": ["sch", "ich", "ung"],
        "fx_es": ["cion", "ado", "idad", "que"],
        "fx_rare": ["gan", "gat", "llm", "bert", "gam", "lad"],
    },
    {"fx_articles": "Articles", "fx_rare": "Rare parts"},
)
