"""Evaluation configuration: languages, datasets, tag vocabularies, models.

Config is small and fixed at job-build time, so it is turned into literal
expressions (maps / arrays) or tiny literal DataFrames: lookups then need no
join and no broadcast, and the plan stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied pipeline's vocabularies)
# ---------------------------------------------------------------------------
PARAPHRASE_CLASSES = ("literal_match", "paraphrase", "requires_inference")
OPENBOOK, CLOSEDBOOK = "openbook", "closedbook"
MT_METRICS = ("chrf", "comet", "adequacy", "fluency")
# metric rescaling onto ~0-100 for side-by-side charts
METRIC_SCALE = {"chrf": 1.0, "comet": 100.0, "adequacy": 20.0, "fluency": 20.0}
# delta classes: MT drop / gain beyond 3 points, QA alert at -30 pp or lower
MT_DELTA_BAND = 3.0
QA_ALERT_PP = -30.0


@dataclass(frozen=True)
class LangSpec:
    lang: str
    name: str
    native_dataset: str | None       # null: a language with translations only
    translated_dataset: str | None
    phenomena: tuple[str, ...]
    domains: tuple[str, ...] = ()
    required: tuple[str, ...] = ()   # MT quota buckets that gate sampling
    bonus: tuple[str, ...] = ()      # MT buckets tracked but not gating
    native_label: str | None = None      # names shown for the datasets
    translated_label: str | None = None


@dataclass(frozen=True)
class EvalConfig:
    langs: tuple[LangSpec, ...]
    models: tuple[str, ...]
    conditions: tuple[str, ...] = (OPENBOOK, CLOSEDBOOK)
    # dataset -> allowed conditions; datasets absent here get ``conditions``
    dataset_conditions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    model_labels: tuple[tuple[str, str], ...] = ()
    paraphrase: tuple[str, ...] = PARAPHRASE_CLASSES
    mt_langs: tuple[str, ...] = ()
    bad_gold_ids: tuple[str, ...] = ()

    # -- plain lookups -----------------------------------------------------
    def lang(self, code: str) -> LangSpec:
        return {s.lang: s for s in self.langs}[code]

    @property
    def lang_codes(self) -> tuple[str, ...]:
        return tuple(s.lang for s in self.langs)

    @property
    def datasets(self) -> tuple[str, ...]:
        return tuple(d for _, d, _ in self.benchmarks)

    @property
    def benchmarks(self) -> tuple[tuple[str, str, str], ...]:
        """(lang, dataset, role) in canonical order; languages without QA have none."""
        return tuple((s.lang, d, role) for s in self.langs
                     for d, role in ((s.native_dataset, "native"), (s.translated_dataset, "translated")) if d)

    @property
    def all_phenomena(self) -> tuple[str, ...]:
        seen: dict[str, None] = {}
        for s in self.langs:
            for p in s.phenomena:
                seen[p] = None
        return tuple(seen)

    @property
    def all_domains(self) -> tuple[str, ...]:
        seen: dict[str, None] = {}
        for s in self.langs:
            for d in s.domains:
                seen[d] = None
        return tuple(seen)

    def conditions_for(self, dataset: str) -> tuple[str, ...]:
        return dict(self.dataset_conditions).get(dataset, self.conditions)

    # -- literal column expressions ---------------------------------------
    def dataset_rank(self, col: Column | str) -> Column:
        """Canonical dataset order (per language: native, translated); unknown -> null."""
        return _lookup({d: F.lit(i) for i, d in enumerate(self.datasets)}, col)

    def model_rank(self, col: Column | str) -> Column:
        m = F.create_map(*[x for i, d in enumerate(self.models) for x in (F.lit(d), F.lit(i))])
        return F.try_element_at(m, _c(col))

    def lang_rank(self, col: Column | str) -> Column:
        m = F.create_map(*[x for i, d in enumerate(self.lang_codes) for x in (F.lit(d), F.lit(i))])
        return F.try_element_at(m, _c(col))

    def dataset_role(self, col: Column | str) -> Column:
        """'native' / 'translated' / null for a dataset name."""
        return _lookup({d: F.lit(role) for _, d, role in self.benchmarks}, col)

    def native_dataset(self, lang_col: Column | str) -> Column:
        return _lookup({s.lang: F.lit(s.native_dataset) for s in self.langs if s.native_dataset}, lang_col)

    def domains_of(self, lang_col: Column | str) -> Column:
        """Per-language domain vocabulary as an array expression."""
        return _lookup({s.lang: F.array(*[F.lit(d) for d in s.domains]).cast("array<string>") for s in self.langs}, lang_col)

    def phenomena_of(self, lang_col: Column | str) -> Column:
        """Per-language phenomenon vocabulary as an array expression."""
        m = F.create_map(*[x for s in self.langs
                           for x in (F.lit(s.lang), F.array(*[F.lit(p) for p in s.phenomena]))])
        return F.try_element_at(m, _c(lang_col))

    def required_of(self, lang_col: Column | str) -> Column:
        m = F.create_map(*[x for s in self.langs
                           for x in (F.lit(s.lang), F.array(*[F.lit(p) for p in s.required]).cast("array<string>"))])
        return F.try_element_at(m, _c(lang_col))

    def conditions_of(self, dataset_col: Column | str) -> Column:
        """Allowed conditions of a dataset as an array expression."""
        default = F.array(*[F.lit(c) for c in self.conditions])
        if not self.dataset_conditions:
            return default
        m = F.create_map(*[x for d, cs in self.dataset_conditions
                           for x in (F.lit(d), F.array(*[F.lit(c) for c in cs]))])
        return F.coalesce(F.try_element_at(m, _c(dataset_col)), default)

    def model_label(self, col: Column | str) -> Column:
        labels = dict(self.model_labels)
        m = F.create_map(*[x for k in self.models for x in (F.lit(k), F.lit(labels.get(k, k)))])
        return F.coalesce(F.try_element_at(m, _c(col)), _c(col))

    def dataset_label(self, col: Column | str) -> Column:
        """The name shown for a dataset; its own where none is configured."""
        labels = {d: label for s in self.langs for d, label in ((s.native_dataset, s.native_label), (s.translated_dataset, s.translated_label))
                  if d and label}
        return F.coalesce(_lookup({d: F.lit(label) for d, label in labels.items()}, col).cast("string"), _c(col))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lookup(values: dict[str, Column], col: Column | str) -> Column:
    """The value of a literal map, null for other keys and for an empty map."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), _c(col))


# ---------------------------------------------------------------------------
# Presets
# ---------------------------------------------------------------------------
_FIX_PHEN = ("newline", "pipe", "email", "long")
_FIX_DOM = ("local_history", "local_geography", "general")


def _fixture_lang(code: str, name: str) -> LangSpec:
    return LangSpec(code, name, f"{code}_native", f"{code}_translated", _FIX_PHEN, _FIX_DOM,
                    required=("newline", "long", "pipe"), bonus=("email",),
                    native_label=f"{name} (native)", translated_label=f"{name} (translated)")


# Configuration of the views over the driver's tables (FIXTURES.md B).
FIXTURE = EvalConfig(
    langs=(_fixture_lang("de", "German"), _fixture_lang("en", "English"),
           _fixture_lang("es", "Spanish"), _fixture_lang("fr", "French")),
    models=("m0", "m1", "m2", "m3"),
    model_labels=(("m0", "Model 0"), ("m1", "Model 1"), ("m2", "Model 2"), ("m3", "Model 3")),
    mt_langs=("de", "en", "fr"),
)

# The studied pilot's languages, datasets, vocabularies and models.
PILOT = EvalConfig(
    langs=(
        LangSpec("id", "Indonesian", "indoqa", "squad_id",
                 ("voice_meN", "voice_di", "reduplication", "complex_NP_yang"),
                 ("indonesian_history", "indonesian_geography", "general"),
                 required=("voice_meN", "voice_di", "complex_NP_yang"), bonus=("reduplication",),
                 native_label="IndoQA (native)", translated_label="SQuAD-ID (Gemini translated)"),
        LangSpec("sw", "Swahili", "tydiqa_sw", "squad_sw",
                 ("noun_class_concord", "applicative", "passive", "locative_ni"),
                 ("east_african_history", "east_african_geography", "general"),
                 required=("noun_class_concord", "passive", "locative_ni"), bonus=("applicative",),
                 native_label="TyDi QA Swahili (native)", translated_label="SQuAD-SW (Gemini translated)"),
        LangSpec("fr", "French", None, None,
                 ("clitic_pronoun", "subjunctive", "complex_NP_relative", "past_participle_agreement"),
                 required=("clitic_pronoun", "subjunctive", "complex_NP_relative"), bonus=("past_participle_agreement",)),
    ),
    models=("gemini_3_pro", "deepseek_v4_pro", "gemma_4_31b_it", "llama_31_8b"),
    model_labels=(("gemini_3_pro", "Gemini 3.1 Pro"), ("deepseek_v4_pro", "DeepSeek V4 Pro"),
                  ("gemma_4_31b_it", "Gemma 4 31B"), ("llama_31_8b", "Llama 3.1 8B")),
    mt_langs=("id", "sw", "fr"),
    bad_gold_ids=(
        "tydiqa_sw_swahili-621776127146134670-2",
        "tydiqa_sw_swahili-8216132447498963245-51",
        "tydiqa_sw_swahili--8490159616452737784-9",
        "tydiqa_sw_swahili--7571808641324368696-0",
    ),
)
