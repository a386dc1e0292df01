"""The vocabulary of tags: fixed names, and column functions between what is shown and what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names as they appear in files and in tag lists.
SUBCATEGORIES = {
    "All Drums": ["Beats", "Cymbal", "Hi-Hat", "Kick", "Kits", "Snare", "Tom"],
    "Bass": ["Acoustic Bass", "Elec Bass", "Synthetic Bass"],
    "Brass": ["French Horn", "Harmonica", "Trombone", "Trumpet", "Tuba"],
    "FX": ["Ambience", "Animals", "Explosions", "Foley", "Impacts", "Machines", "Misc.", "People", "Sci-Fi", "Sports", "Stingers", "Transportation", "Weapons", "Work/Home"],
    "Guitars": ["Acoustic Guitar", "Banjo", "Elec Guitar", "Mandolin", "Pedal Steel", "Slide Guitar"],
    "Horn": ["Bagpipe", "Bassoon", "Clarinet", "English Horn", "Flute", "French Horn", "Harmonica", "Oboe", "Pan Flute", "Piccolo", "Recorder", "Saxophone", "Trombone", "Trumpet"],
    "Jingles": [],
    "Keyboards": ["Accordion", "Celesta", "Clavinet", "Elec Piano", "Harpsichord", "Organ", "Piano", "Synths"],
    "Mallets": ["Bell", "Kalimba", "Marimba", "Steel Drum", "Timpani", "Vibes", "Xylophone"],
    "Other Inst": [],
    "Percussion": ["Bongo", "Chime", "Clave", "Conga", "Cowbell", "Gong", "Rattler", "Shaker", "Tambourine", "Vinyl"],
    "Strings": ["Cello", "Double Bass", "Harp", "Koto", "Sitar", "Viola", "Violin"],
    "Textures": [],
    "Vocals": ["Choir", "Female", "Male"],
    "Woodwind": ["Bagpipe", "Bassoon", "Clarinet", "Flute", "Oboe", "Pan Flute", "Recorder", "Saxophone"],
}
#: Shown name -> stored name, where they differ.
STORED_CATEGORIES = {
    "All Drums": "Drums",
    "FX": "Sound Effect",
    "Horn": "Horn/Wind",
    "Jingles": "Mixed",
    "Other Inst": "Other Instrument",
    "Textures": "Texture/Atmosphere",
}
STORED_SUBCATEGORIES = {
    "Beats": "Electronic Beats",
    "Hi-Hat": "Hi-hat",
    "Kits": "Drum Kit",
    "Elec Bass": "Electric Bass",
    "Elec Guitar": "Electric Guitar",
    "Pedal Steel": "Pedal Steel Guitar",
    "Elec Piano": "Electric Piano",
    "Synths": "Synthesizer",
    "Vibes": "Vibraphone",
    "Vinyl": "Vinyl/Scratch",
    "Impacts": "Impacts & Crashes",
    "Sports": "Sports & Leisure",
    "Stingers": "Motions & Transitions",
    "Machines": "Mech/Tech",
}
DESCRIPTORS = [
    "Grooving", "Part", "Single", "Melodic", "Clean", "Electric", "Processed", "Acoustic", "Dry",
    "Relaxed", "Cheerful", "Intense", "Ensemble", "Dark", "Distorted", "Fill", "Arrhythmic", "Dissonant",
]
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}
#: Scale codes in files; 0 is "Any" for a loop with a key.
SCALES = {1: "Minor", 2: "Major", 3: "Neither", 4: "Both"}
NO_KEY = 0xFFFF


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The value's other name, or the value itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[value], value)


def reverse(names: dict[str, str]) -> dict[str, str]:
    return {v: k for k, v in names.items()}


def shown_category(stored: Column) -> Column:
    return mapped(stored, reverse(STORED_CATEGORIES))


def shown_subcategory(stored: Column) -> Column:
    return mapped(stored, reverse(STORED_SUBCATEGORIES))


def stored_category(shown: Column) -> Column:
    return mapped(shown, STORED_CATEGORIES)


def stored_subcategory(shown: Column) -> Column:
    return mapped(shown, STORED_SUBCATEGORIES)


def subcategories(category: Column) -> Column:
    """The subcategories of a shown category; empty for an unknown one."""
    empty = F.array().cast("array<string>")
    table = F.create_map(*[x for c, subs in SUBCATEGORIES.items() for x in (F.lit(c), F.array(*map(F.lit, subs)).cast("array<string>"))])
    return F.coalesce(table[category], empty)


def subcategories_apply(category: Column) -> Column:
    """False only for a known category without subcategories."""
    return F.coalesce(~category.isin([c for c, subs in SUBCATEGORIES.items() if not subs]), F.lit(True))


def all_subcategories() -> list[str]:
    return sorted({s for subs in SUBCATEGORIES.values() for s in subs})


def taxonomy(spark: SparkSession) -> DataFrame:
    """Dimension table of the vocabulary's (category, subcategory) pairs; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame([(c, s) for c, subs in SUBCATEGORIES.items() for s in subs], "category string, subcategory string")


def category_names(spark: SparkSession) -> DataFrame:
    """Dimension table (stored, shown) of all categories."""
    return spark.createDataFrame([(STORED_CATEGORIES.get(c, c), c) for c in SUBCATEGORIES], "stored string, shown string")


def subcategory_names(spark: SparkSession) -> DataFrame:
    """Dimension table (stored, shown) of the subcategories whose names differ."""
    return spark.createDataFrame([(v, k) for k, v in STORED_SUBCATEGORIES.items()], "stored string, shown string")


def note_name(note: Column) -> Column:
    """Name of a MIDI note as key; '' outside 1..127 and where the remainder of note - 48, truncated towards zero, is negative."""
    names = F.array(*map(F.lit, NOTE_NAMES))
    step = (note - 48) % 12
    return F.when((note > 0) & (note < 128) & (step >= 0), F.get(names, step.cast("int"))).otherwise("")


def note_number(name: Column) -> Column:
    """48..59 for the twelve sharp names, else 0."""
    place = F.array_position(F.array(*map(F.lit, NOTE_NAMES)), name)
    return F.when(place > 0, place + 47).otherwise(0).cast("bigint")


def sharp_name(name: Column) -> Column:
    return mapped(name, FLATS)


def scale_name(code: Column, has_key: Column) -> Column:
    out = F.when(has_key, "Any").otherwise("")
    for c, name in SCALES.items():
        out = F.when(code == c, name).otherwise(out)
    return out


def scale_code(name: Column) -> Column:
    out = F.lit(0)
    for c, s in SCALES.items():
        out = F.when(F.lower(name) == s.lower(), c).otherwise(out)
    return out.cast("bigint")


def key_type(scale: Column) -> Column:
    """Scale name as written in pair lists."""
    return F.lower(scale)


def scale_of_key_type(text: Column) -> Column:
    """Scale name of a pair list's text in any case; '' if unknown."""
    out = F.lit("")
    for s in ["Any", *SCALES.values()]:
        out = F.when(F.lower(text) == s.lower(), s).otherwise(out)
    return out


def scale_label(name: Column) -> Column:
    return F.when(name == "Both", "Good for Both").otherwise(name)
