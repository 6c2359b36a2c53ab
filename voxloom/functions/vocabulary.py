"""Fixed vocabularies, catalogs and rule tables of the curation domain.

Everything below is a fixed value that results depend on; none of it grows with the data, which is
why these tables (and only these) are broadcast without a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Measurement states.
STATUSES = ("measured", "uncalibrated", "unavailable", "legacy_unknown", "invalid")

# Targets, eligibility, roles and reason codes.
TARGETS = ("talk", "singing")
ELIGIBILITIES = ("eligible", "needs_review", "excluded")
ROLES = ("primary", "feature_only", "review", "excluded")
REASON_CODES = (
    "user_excluded", "wrong_speaker", "unreadable_audio", "no_usable_voice",
    "wrong_content_type", "alignment_required", "rare_phoneme", "speaker_unconfirmed",
)

# Alignment methods.
FORCED_ALIGNMENT = "mfa-japanese-phone-forced-alignment-v1"
PLACEHOLDER_ALIGNMENT = "legacy-uniform-placeholder"
INVALIDATED_ALIGNMENT = "invalidated-by-transcript-override"
REVIEWED_ALIGNMENT = "transcript-review-estimated"
WORD_BOUNDARY_ALIGNMENT = "asr-word-boundary-proportional"

# Media extensions.
AUDIO_EXTENSIONS = ("wav", "flac", "mp3", "m4a", "ogg", "opus")
VIDEO_EXTENSIONS = ("mp4", "mkv", "webm", "mov", "avi", "m4v")

# The phone catalog.
VOWELS = ("a", "i", "u", "e", "o")
CORE_PHONES = (
    "a", "i", "u", "e", "o", "k", "s", "t", "n", "h", "m", "y", "r", "w",
    "g", "z", "d", "b", "p", "N", "cl",
)
PALATALIZED_PHONES = ("ky", "gy", "sh", "j", "ch", "ny", "hy", "by", "py", "my", "ry")
VOICED_PHONES = ("g", "z", "d", "b")
SEMI_VOICED_PHONES = ("p",)
SPECIAL_PHONES = ("cl", "N", ":")
FOREIGN_PHONES = ("f", "v", "ts", "ty", "dy", "kw", "gw")
KNOWN_PHONES = CORE_PHONES + PALATALIZED_PHONES + FOREIGN_PHONES
STANDALONE_PHONES = ("N", "cl", ":", "SP", "AP")
CONSONANTS = tuple(p for p in KNOWN_PHONES if p not in VOWELS and p not in ("N", "cl"))

# Coverage categories (name, expected phones).
PHONE_CATEGORIES = {
    "palatalized": PALATALIZED_PHONES,
    "voiced": VOICED_PHONES,
    "semi_voiced": SEMI_VOICED_PHONES,
    "special": SPECIAL_PHONES,
    "foreign": FOREIGN_PHONES,
}

# Kana and the phones each one needs.
KANA_PHONES = {
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o",
    "か": "k a", "き": "k i", "く": "k u", "け": "k e", "こ": "k o",
    "さ": "s a", "し": "sh i", "す": "s u", "せ": "s e", "そ": "s o",
    "た": "t a", "ち": "ch i", "つ": "ts u", "て": "t e", "と": "t o",
    "な": "n a", "に": "n i", "ぬ": "n u", "ね": "n e", "の": "n o",
    "は": "h a", "ひ": "h i", "ふ": "f u", "へ": "h e", "ほ": "h o",
    "ま": "m a", "み": "m i", "む": "m u", "め": "m e", "も": "m o",
    "や": "y a", "ゆ": "y u", "よ": "y o",
    "ら": "r a", "り": "r i", "る": "r u", "れ": "r e", "ろ": "r o",
    "わ": "w a", "を": "o", "ん": "N",
    "が": "g a", "ぎ": "g i", "ぐ": "g u", "げ": "g e", "ご": "g o",
    "ざ": "z a", "じ": "j i", "ず": "z u", "ぜ": "z e", "ぞ": "z o",
    "だ": "d a", "ぢ": "j i", "づ": "z u", "で": "d e", "ど": "d o",
    "ば": "b a", "び": "b i", "ぶ": "b u", "べ": "b e", "ぼ": "b o",
    "ぱ": "p a", "ぴ": "p i", "ぷ": "p u", "ぺ": "p e", "ぽ": "p o",
    "きゃ": "ky a", "きゅ": "ky u", "きょ": "ky o",
    "しゃ": "sh a", "しゅ": "sh u", "しょ": "sh o",
    "ちゃ": "ch a", "ちゅ": "ch u", "ちょ": "ch o",
    "にゃ": "ny a", "にゅ": "ny u", "にょ": "ny o",
    "ひゃ": "hy a", "ひゅ": "hy u", "ひょ": "hy o",
    "みゃ": "my a", "みゅ": "my u", "みょ": "my o",
    "りゃ": "ry a", "りゅ": "ry u", "りょ": "ry o",
    "ぎゃ": "gy a", "ぎゅ": "gy u", "ぎょ": "gy o",
    "じゃ": "j a", "じゅ": "j u", "じょ": "j o",
    "びゃ": "by a", "びゅ": "by u", "びょ": "by o",
    "ぴゃ": "py a", "ぴゅ": "py u", "ぴょ": "py o",
}

# Internal phone -> aligner alphabet.
ALIGNER_ALPHABET = {
    "a": "a", "i": "i", "e": "e", "o": "o", "k": "k", "s": "s", "z": "z", "ts": "ts", "t": "t",
    "d": "d", "n": "n", "h": "h", "b": "b", "p": "p", "m": "m", "w": "w", "v": "v",
    "u": "ɯ", "g": "ɡ", "r": "ɾ", "y": "j", "N": "ɴ", "sh": "ɕ", "ch": "tɕ", "j": "dʑ", "f": "ɸ",
    "ky": "c", "gy": "ɟ", "I": "i̥", "U": "ɯ̥", "ny": "ɲ", "hy": "ç", "my": "mʲ", "by": "bʲ",
    "py": "pʲ", "ry": "ɾʲ", "ty": "tʲ", "dy": "dʲ",
}
# Aligner spellings of the same phone.
PHONE_ALIASES = {"ɡ": "g", "ɾ": "r"}

# Provenance features and the method recorded for each (None: follows the alignment).
PROVENANCE_METHODS = (
    ("transcript", "faster-whisper"),
    ("phonemes", None),
    ("f0", "autocorrelation"),
    ("energy", "rms"),
    ("voicing", "pitch-confidence"),
    ("style_prosody", "summary-statistics"),
    ("speaker_embedding", "speaker-centroid"),
)
PHONEME_METHOD_PREFIX = "pyopenjtalk+"

# Built-in strategies (id, version, target, preset ids, capabilities available).
STRATEGIES = (
    ("builtin.talk_speech_teacher", "1.0.0", "talk", (), True),
    ("builtin.talk_singing_timbre", "1.0.0", "talk", (), True),
    ("builtin.talk_style_adaptation", "1.0.0", "talk",
     ("builtin.expressive_complex", "builtin.characterized", "builtin.powerful", "builtin.soft_breathy"), False),
    ("builtin.singing_singing_teacher", "1.0.0", "singing", (), True),
    ("builtin.singing_speech_timbre", "1.0.0", "singing", (), False),
    ("builtin.singing_expressive", "1.0.0", "singing",
     ("builtin.expressive_complex", "builtin.characterized", "builtin.powerful", "builtin.soft_breathy"), False),
)
# Requirements (strategy id, role, metric, op, value).
REQUIREMENTS = (
    ("builtin.talk_speech_teacher", "speech_teacher", "eligible_seconds", "gte", 60.0),
    ("builtin.talk_speech_teacher", "speech_teacher", "independent_utterances", "gte", 10.0),
    ("builtin.talk_singing_timbre", "singing_teacher", "eligible_seconds", "gte", 30.0),
    ("builtin.talk_style_adaptation", "speech_teacher", "eligible_seconds", "gte", 300.0),
    ("builtin.talk_style_adaptation", "speech_teacher", "independent_utterances", "gte", 50.0),
    ("builtin.singing_singing_teacher", "singing_teacher", "eligible_seconds", "gte", 300.0),
    ("builtin.singing_singing_teacher", "singing_teacher", "independent_phrases", "gte", 30.0),
    ("builtin.singing_singing_teacher", "singing_teacher", "pitch_bins_observed", "gte", 3.0),
    ("builtin.singing_speech_timbre", "speech_teacher", "eligible_seconds", "gte", 60.0),
    ("builtin.singing_expressive", "singing_teacher", "eligible_seconds", "gte", 900.0),
    ("builtin.singing_expressive", "singing_teacher", "independent_phrases", "gte", 80.0),
)
# Stages (strategy id, stage id, operation is a training step, input roles, output types).
STAGES = (
    ("builtin.talk_speech_teacher", "speech_base", True, ("speech_teacher",), ("tts_base", "talk_model", "model_artifact")),
    ("builtin.talk_speech_teacher", "evaluate_unseen_text", False, ("speech_teacher",), ("verification_report",)),
    ("builtin.talk_singing_timbre", "speaker_timbre_adaptation", False, ("singing_teacher",), ("speaker_identity", "talk_model", "model_artifact")),
    ("builtin.talk_singing_timbre", "evaluate_unseen_text", False, ("identity_reference",), ("verification_report",)),
    ("builtin.talk_style_adaptation", "speech_base", True, ("speech_teacher",), ("tts_base", "talk_model", "model_artifact")),
    ("builtin.talk_style_adaptation", "talk_style_adaptation", False, ("speech_teacher", "texture_reference"), ("talk_model", "model_artifact")),
    ("builtin.talk_style_adaptation", "evaluate_unseen_text", False, ("speech_teacher",), ("verification_report",)),
    ("builtin.singing_singing_teacher", "acoustic", False, ("singing_teacher",), ("singing_base", "singing_model", "model_artifact")),
    ("builtin.singing_singing_teacher", "evaluate_unseen_notes", False, ("singing_teacher",), ("verification_report",)),
    ("builtin.singing_speech_timbre", "speaker_timbre_adaptation", False, ("speech_teacher", "identity_reference"), ("speaker_identity", "singing_model", "model_artifact")),
    ("builtin.singing_speech_timbre", "evaluate_unseen_notes", False, ("identity_reference",), ("verification_report",)),
    ("builtin.singing_expressive", "acoustic", False, ("singing_teacher",), ("singing_base", "model_artifact")),
    ("builtin.singing_expressive", "expression_adaptation", False, ("singing_teacher", "texture_reference"), ("singing_model", "model_artifact")),
    ("builtin.singing_expressive", "evaluate_unseen_notes", False, ("singing_teacher",), ("verification_report",)),
)


def fixed_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A constant table, marked for broadcast: its size is fixed by this module, not by data."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def category_phones(spark: SparkSession) -> DataFrame:
    rows = [(c, p) for c, phones in PHONE_CATEGORIES.items() for p in phones]
    return fixed_table(spark, rows, "category string, phoneme string")


def aligner_alphabet(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, ALIGNER_ALPHABET.items(), "phoneme string, encoded string")


def strategies(spark: SparkSession) -> DataFrame:
    rows = [(i, v, t, list(p), a) for i, v, t, p, a in STRATEGIES]
    return fixed_table(spark, rows, "strategy_id string, version string, target string, preset_ids array<string>, available boolean")


def requirements(spark: SparkSession) -> DataFrame:
    return fixed_table(spark, REQUIREMENTS, "strategy_id string, role string, metric string, op string, required double")


def stages(spark: SparkSession) -> DataFrame:
    rows = [(i, s, t, list(a), list(b)) for i, s, t, a, b in STAGES]
    return fixed_table(
        spark, rows,
        "strategy_id string, stage_id string, trains boolean, input_roles array<string>, output_types array<string>",
    )
