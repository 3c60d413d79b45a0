"""The preset library and its use as merge layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The shipped presets as (preset, layer, {option: value}).
PRESETS = (
    (
        "base-kobo",
        "base",
        {
            "output-profile": "kobo",
            "epub-version": "3",
            "base-font-size": "12",
            "minimum-line-height": "1.3",
            "font-size-mapping": "8,9,10,11,12,13,14,16",
            "pdf-engine": "calibre",
            "pdf-header-skip": "-1",
            "pdf-footer-skip": "-1",
        },
    ),
    ("col-1", "columns", {"unwrap-factor": "0.35"}),
    ("col-2", "columns", {"unwrap-factor": "0.20", "flow-size": "650"}),
    ("col-fijo", "columns", {"disable-unwrap-lines": True}),
    (
        "combo-tech",
        "content",
        {
            "enable-heuristics": True,
            "dont-split-on-page-breaks": True,
            "keep-ligatures": True,
            "embed-all-fonts": True,
            "subset-embedded-fonts": True,
        },
    ),
    (
        "math-conservador",
        "content",
        {"enable-heuristics": True, "disable-unwrap-lines": True, "keep-ligatures": True, "subset-embedded-fonts": True},
    ),
    (
        "img-fidelidad",
        "content",
        {
            "epub-max-image-size": "profile",
            "preserve-cover-aspect-ratio": True,
            "extra-css": "img,figure{break-inside:avoid;page-break-inside:avoid;}\nimg{max-width:100%;height:auto;}",
        },
    ),
    ("img-ligero", "content", {"epub-max-image-size": "1200x1600", "filter-css": "box-shadow,filter"}),
    (
        "toc-robusto-es",
        "toc",
        {
            "chapter": "//h:h1 | //h:h2",
            "chapter-mark": "pagebreak",
            "page-breaks-before": "//h:figure | //h:h1 | //h:h2",
            "level1-toc": "//h:h1 | //h:h2",
            "level2-toc": "//h:h3",
            "toc-threshold": "0",
            "max-toc-links": "0",
        },
    ),
    ("toc-minimo", "toc", {"chapter": "//h:h1", "chapter-mark": "pagebreak", "level1-toc": "//h:h1", "toc-threshold": "5"}),
    ("toc-sencillo", "toc", {"chapter-mark": "none", "no-chapters-in-toc": True}),
    (
        "cleanup-suave",
        "cleanup",
        {"enable-heuristics": True, "disable-delete-blank-paragraphs": True, "disable-fix-indents": True},
    ),
    (
        "cleanup-css",
        "cleanup",
        {"filter-css": "margin-left,margin-right,padding-left,padding-right", "extra-css": "body{margin:0 auto;}"},
    ),
    ("cleanup-parrafos", "cleanup", {"remove-paragraph-spacing": True, "remove-paragraph-spacing-indent-size": "1.2"}),
    ("debug-verbose", "debug", {"verbose": True}),
    ("debug-pipeline", "debug", {"debug-pipeline": "./debug-oeb"}),
)


def preset_rows() -> list[tuple[str, str, str, str, str]]:
    """The library in long form: (preset, layer, key, value, kind)."""
    return [
        (name, layer, key, "true" if value is True else value, "bool" if value is True else "text")
        for name, layer, options in PRESETS
        for key, value in options.items()
    ]


def shipped_presets(spark: SparkSession) -> DataFrame:
    """The library as ``(preset, layer, key, value, kind)``."""
    return spark.createDataFrame(preset_rows(), "preset STRING, layer STRING, key STRING, value STRING, kind STRING")


def as_layers(selections: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Merge layers for ``selections(entity_id, position, preset)``; ``library``
    (by default the shipped presets) may hold saved ones as well."""
    library = shipped_presets(selections.sparkSession) if library is None else library
    return selections.join(library, "preset").select(
        "entity_id", "layer", "position", "preset", "key", "value", "kind"
    )
