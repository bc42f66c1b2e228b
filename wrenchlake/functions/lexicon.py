"""The words that the service-document operators look for, in one object, so that other shops can bring their own."""

from __future__ import annotations

from dataclasses import dataclass

# The default word lists.  Results depend on them, so they are stated plainly and in their natural order.
TOPICS = (
    "ventilation", "leveling", "level", "ambient", "air leak", "thermistor", "cooling unit", "heating element", "heater", "igniter",
    "electrode", "high voltage", "solenoid", "orifice", "flue baffle", "flue tube", "burner", "upper circuit board",
    "lower circuit board", "control board", "fuse", "wiring", "dc volt", "ac volt", "lp gas", "propane", "manual gas", "door seal",
    "frame heater", "climate control", "diagnostic mode", "error code", "fault code", "sequence of operation", "ohms", "voltage",
)
BRANDS = (
    "furrion", "norcold", "dometic", "suburban", "atwood", "lippert", "lci", "bal", "keystone", "jayco", "brinkley", "kz", "victron",
    "renogy", "wfco", "progressive dynamics", "power gear", "schwintek", "carefree", "intelli-power", "pd", "on-an", "onan", "generac",
    "winegard",
)
SIGNALS = (
    "check ", "measure", "volt", "ohm", "if ", "disconnect", "replace", "inspect", "amp", "continuity", "resistance", "should be", "spec",
    "heating element", "thermistor", "cooling unit", "ventilation", "burner",
)
CORE_TRIGGERS = ("cool", "gas", "electric", "ac", "refriger")
CORE_TERMS = ("heating", "element", "thermistor", "cooling", "unit", "ventilation", "burner", "orifice", "solenoid", "igniter", "board", "fuse", "voltage")
OPEN_MARKERS = (
    "no fix yet", "not repaired", "not repaired yet", "unit not repaired", "not fixed", "no repair", "still open", "handoff",
    "hold this info", "not finished", "incomplete", "left off", "pick up", "will press button", "need warranty story",
)
DONE_MARKERS = ("job complete", "repair completed", "replaced the", "compressor started", "compressor ran", "returned to service")
CHART_CUES = ("no operation", "insufficient cooling", "no gas", "no ac", "freezes")
INTENTS = {
    "gas": ("gas", "lp", "propane", "flame", "igniter", "burner"),
    "ac": ("ac", "electric", "120", "element", "shore"),
    "cool": ("cool", "cold", "warm", "temp", "not cooling", "won't cool", "wont cool"),
    "dead": ("dead", "no power", "no operation", "won't turn", "wont turn", "blank"),
    "lights_off": ("no light", "no panel", "dark", "blank display"),
    "lights_on": ("display is on", "lights on", "panel on", "display on"),
    "freeze": ("freeze", "freezing", "frozen", "too cold"),
}
EARLY_PAGES = (6, 7, 9, 10)
SHARED_CATEGORY = "TSB / Recall"


@dataclass(frozen=True)
class Lexicon:
    """``short_brand`` counts only where one of ``short_brand_needs`` occurs too."""

    topics: tuple[str, ...] = TOPICS
    brands: tuple[str, ...] = BRANDS
    short_brand: str = "pd"
    short_brand_needs: tuple[str, ...] = ("progressive", "intelli")
    signals: tuple[str, ...] = SIGNALS
    core_triggers: tuple[str, ...] = CORE_TRIGGERS
    core_terms: tuple[str, ...] = CORE_TERMS
    open_markers: tuple[str, ...] = OPEN_MARKERS
    done_markers: tuple[str, ...] = DONE_MARKERS
    early_pages: tuple[int, ...] = EARLY_PAGES


DEFAULT = Lexicon()
