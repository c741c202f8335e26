"""The searches that an update runs, as data."""

from __future__ import annotations

# The queries of each service, in the order in which their results are joined.
QUERIES: dict[str, list[str]] = {
    "pubmed": [
        "(3D genome OR three-dimensional genome OR chromatin architecture) AND (deep learning OR neural network)",
        "(Hi-C OR HiC) AND (deep learning OR convolutional neural network OR transformer)",
        "(chromatin loop OR TAD OR topologically associating domain) AND (deep learning OR machine learning OR graph neural network)",
        "(chromatin conformation OR chromosome conformation) AND (deep learning OR generative model OR diffusion model)",
        "(3D genome structure prediction) AND (deep learning OR neural network)",
        "(single-cell Hi-C OR scHi-C) AND (deep learning OR machine learning)",
        "(Hi-C OR Micro-C OR HiChIP OR PLAC-seq) AND (computational OR algorithm OR method)",
        "(Capture-C OR Capture Hi-C OR promoter capture) AND (genome organization OR chromatin)",
        "(4C-seq OR 5C OR chromosome conformation capture) AND (computational OR analysis pipeline)",
        "(SPRITE OR GAM OR genome architecture mapping) AND (3D genome OR chromatin)",
        "(ChIA-PET OR ChIA-Drop) AND (chromatin interaction OR 3D genome)",
        "(DNA-FISH OR chromatin tracing OR ORCA imaging) AND (3D genome OR chromosome)",
        "(DamID OR TRIP OR TSA-seq OR nuclear speckle) AND (genome organization)",
        "(Pore-C OR concatemer) AND (chromatin OR genome structure)",
        "(CUT&RUN OR CUT&Tag) AND (3D genome OR chromatin architecture)",
        "(nuclear organization OR nuclear architecture) AND (deep learning OR computational)",
        "(lamina-associated domain OR LAD) AND (genome organization OR computational)",
        "(nuclear speckle OR nuclear body OR nucleolus) AND (genome organization)",
        "(phase separation OR liquid-liquid phase) AND (chromatin OR 3D genome)",
        "(CTCF OR cohesin OR loop extrusion) AND (computational OR modeling OR deep learning)",
        "(polymer model OR polymer simulation) AND (chromatin OR chromosome OR 3D genome)",
        "(enhancer-promoter interaction) AND (prediction OR deep learning OR machine learning)",
        "(chromatin accessibility OR ATAC-seq) AND (3D genome OR Hi-C) AND computational",
        "(genome folding OR chromosome folding) AND (prediction OR deep learning)",
        "(contact map OR contact matrix) AND (deep learning OR neural network)",
        "(topological domain OR chromatin domain) AND (prediction OR classification OR deep learning)",
        "(Hi-C normalization OR Hi-C bias) AND (method OR algorithm OR computational)",
        "(3D genome browser OR genome visualization) AND (Hi-C OR chromatin)",
        "(3D genome OR chromatin architecture) AND (disease OR cancer OR disorder) AND computational",
        "(structural variant OR translocation) AND (3D genome OR Hi-C OR TAD)",
        "(3D genome OR chromatin conformation) AND (evolution OR conservation OR comparative)",
    ],
    "biorxiv": [
        "3D genome deep learning",
        "Hi-C deep learning",
        "chromatin conformation neural network",
        "TAD prediction deep learning",
        "Hi-C computational method",
        "chromatin loop prediction",
        "genome structure prediction",
        "single-cell Hi-C analysis",
        "Micro-C chromatin",
        "nuclear organization computational",
    ],
    "arxiv": [
        "3D genome deep learning",
        "Hi-C neural network",
        "chromatin structure prediction deep learning",
        "genome folding convolutional network",
        "chromatin contact map prediction",
        "graph neural network genomics chromatin",
    ],
    "semantic_scholar": [
        "3D genome deep learning",
        "Hi-C super resolution deep learning",
        "chromatin loop prediction neural network",
        "TAD boundary prediction machine learning",
        "single cell Hi-C computational",
        "Akita Enformer genome folding",
        "chromatin conformation capture computational methods",
        "3D genome structure prediction polymer model",
        "nuclear organization imaging computational",
        "CTCF cohesin loop extrusion modeling",
    ],
    "europepmc": [
        "(3D genome OR three-dimensional genome) AND (deep learning OR neural network)",
        "(Hi-C OR HiChIP OR Micro-C) AND (deep learning OR computational method)",
        "(chromatin architecture OR nuclear organization) AND (machine learning OR algorithm)",
        "(TAD OR chromatin loop OR compartment) AND (prediction OR detection) AND computational",
        "(chromosome conformation capture) AND (tool OR software OR pipeline)",
    ],
    "crossref": [
        "3D genome deep learning",
        "Hi-C computational method",
        "chromatin architecture machine learning",
        "chromosome conformation capture tools",
    ],
}
CATALOGUE = [{"source": source, "query": query} for source, queries in QUERIES.items() for query in queries]
