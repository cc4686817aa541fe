"""Options of the normalisation, and the named sets of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

# --- fixed values: what each style may be, the default first ----------------------------------------------------------
STYLES = {
    "quote_style": ("keep", "guillemets", "straight", "strip"),
    "range_style": ("compact", "from_to"),
    "phone_style": ("grouped", "digit_by_digit"),
    "symbol_style": ("expand", "preserve"),
    "date_style": ("formal", "spoken"),
    "colon_style": ("contextual", "clock", "ratio"),
    "numeric_date_order": ("day_month_year", "month_day_year", "preserve_ambiguous"),
    "currency_symbol_policy": ("assume_common", "preserve_ambiguous"),
}
# --- fixed values: what each preset changes of the defaults -----------------------------------------------------------
PRESETS = {
    "default": {},
    "tts_friendly": {"quote_style": "strip", "range_style": "from_to", "phone_style": "digit_by_digit", "date_style": "spoken"},
    "conservative": {
        "expand_known_acronyms": False, "spell_unknown_acronyms": False, "normalize_english_words": False,
        "transliterate_latin": False, "repair_homoglyphs": False, "symbol_style": "preserve",
    },
    "search_indexing": {"spell_unknown_acronyms": False, "normalize_english_words": False, "transliterate_latin": False, "quote_style": "straight", "symbol_style": "preserve"},
}


@dataclass(frozen=True)
class Options:
    """Immutable; an unknown style raises ValueError. vocabulary maps lower-case Latin words to readings."""

    expand_known_acronyms: bool = True
    spell_unknown_acronyms: bool = True
    normalize_english_words: bool = True
    transliterate_latin: bool = True
    repair_homoglyphs: bool = True
    validate_dates: bool = True
    parse_thousand_separators: bool = True
    normalize_network_addresses: bool = True
    quote_style: str = "keep"
    range_style: str = "compact"
    phone_style: str = "grouped"
    symbol_style: str = "expand"
    date_style: str = "formal"
    colon_style: str = "contextual"
    numeric_date_order: str = "day_month_year"
    currency_symbol_policy: str = "assume_common"
    vocabulary: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name in STYLES and getattr(self, f.name) not in STYLES[f.name]:
                raise ValueError(f"{f.name} is one of {', '.join(STYLES[f.name])}, not {getattr(self, f.name)!r}")

    @classmethod
    def preset(cls, name: str, **changes) -> Options:
        if name not in PRESETS:
            raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
        return cls(**(PRESETS[name] | changes))
