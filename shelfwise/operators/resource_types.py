"""Resource and media types of bibs (U5): coded bytes and call numbers looked up in fixed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base type of a bib's own code (fixed values).
BASE_TYPES = {
    "-": "unknown", "a": "book", "b": "database", "c": "score", "e": "map", "g": "video_film", "i": "audio_spoken", "j": "audio_music", "k": "graphic", "m": "software", "n": "ebook",
    "o": "kit", "p": "archive", "q": "journal", "r": "object", "s": "score_thesis", "t": "manuscript", "y": "ejournal", "z": "book_thesis",
}
PAPER_TYPES = ("book", "score", "map", "graphic", "kit", "journal", "score_thesis", "manuscript", "book_thesis", "newspaper")
ONLINE_TYPES = ("database", "ebook", "ejournal")
NEWSPAPER_TYPES = ("book", "ebook", "journal", "ejournal", "database")
#: Formats of the first three bytes of 007, and of later bytes for some of these; tried in order (fixed values).
FORMATS_007 = {
    "cbh": "game_handheld_cartridge", "cbr": "game_console_cartridge", "co ": "cdrom", "coh": "game_handheld_cdrom", "cor": "game_console_cdrom", "cot": "game_computer_cdrom", "cr ": "online",
    "cz ": "digital", "mr ": "16mmfilm", "vdv": "dvd", "vdb": "bluray", "go ": "filmstrip", "vdg": "laserdisc", "vf ": "vhs", "gs ": "slide", "vzs": "streaming", "he ": "microfiche",
    "hd ": "microfilm", "hg ": "microopaque", "sz ": "digital", "ta ": "print", "tb ": "largeprint", "tc ": "braille", "td ": "paper",
}
LATER_007 = (
    ("sd ", 5, {"mc": "record_7inch", "md": "record_10inch", "me": "record_12inch"}),
    ("sd ", 5, {"m": "record"}),
    ("sd ", 3, {"d": "record_78rpm", "f": "cd"}),
    ("sr ", 3, {"n": "streaming"}),
    ("ss ", 3, {"l": "cassette"}),
)
#: Bytes 21 (newspaper), 23 (format) and 26 (software) of 008 (fixed values).
NEWSPAPER_BYTE = "n"
FORMATS_008 = {"a": "microfilm", "b": "microfiche", "c": "microopaque", "d": "largeprint", "f": "braille", "o": "online", "q": "digital", "r": "print", "s": "digital"}
SOFTWARE_008 = {"b": "software", "g": "game", "h": "audio", "i": "software"}
#: Several formats at once that stand for one (fixed values).
TOGETHER = {
    ("digital", "online"): "streaming", ("digital", "streaming"): "streaming", ("online", "streaming"): "streaming", ("digital", "online", "streaming"): "streaming",
}
#: Types, and formats that are left, of a base type in one format (fixed values).
TYPE_FORMATS = {
    ("software", "game_handheld_cartridge"): (["game", "handheld"], []), ("software", "game_console_cartridge"): (["game", "console"], []),
    ("software", "game_handheld_cdrom"): (["game", "handheld"], []), ("software", "game_console_cdrom"): (["game", "console"], []),
    ("software", "game_computer_cdrom"): (["game", "computer"], ["cdrom"]), ("software", "cdrom"): (["software", "computer"], ["cdrom"]),
    ("video_film", "16mmfilm"): (["film"], ["16mmfilm"]), ("video_film", "dvd"): (["video", "dvd"], []), ("video_film", "bluray"): (["video", "bluray"], []),
    ("video_film", "filmstrip"): (["filmstrip"], []), ("video_film", "laserdisc"): (["video", "laserdisc"], []), ("video_film", "vhs"): (["video", "vhs"], []),
    ("video_film", "slide"): (["slide"], []), ("video_film", "streaming"): (["video", "streaming"], []),
    ("audio_spoken", "digital"): (["audio", "spoken", "book"], ["digital_device"]), ("audio_spoken", "streaming"): (["audio", "spoken", "streaming"], []),
    ("audio_spoken", "record_7inch"): (["audio", "spoken", "record"], ["record_7inch"]), ("audio_spoken", "record_10inch"): (["audio", "spoken", "record"], ["record_10inch"]),
    ("audio_spoken", "record_12inch"): (["audio", "spoken", "record"], ["record_12inch"]), ("audio_spoken", "record_78rpm"): (["audio", "spoken", "record"], ["record_78rpm"]),
    ("audio_spoken", "record"): (["audio", "spoken", "record"], []), ("audio_spoken", "cd"): (["audio", "spoken", "cd"], []),
    ("audio_spoken", "cassette"): (["audio", "spoken", "cassette"], []), ("audio_music", "streaming"): (["audio", "music", "streaming"], []),
    ("audio_music", "record_7inch"): (["audio", "music", "record"], ["record_7inch"]), ("audio_music", "record_10inch"): (["audio", "music", "record"], ["record_10inch"]),
    ("audio_music", "record_12inch"): (["audio", "music", "record"], ["record_12inch"]), ("audio_music", "record_78rpm"): (["audio", "music", "record"], ["record_78rpm"]),
    ("audio_music", "record"): (["audio", "music", "record"], []), ("audio_music", "cd"): (["audio", "music", "cd"], []),
    ("audio_music", "cassette"): (["audio", "music", "cassette"], []), ("book", "online"): (["ebook"], []), ("book", "streaming"): (["ebook"], []),
    ("book", "digital"): (["ebook"], []), ("journal", "online"): (["ejournal"], []), ("journal", "streaming"): (["ejournal"], []), ("journal", "digital"): (["ejournal"], []),
    ("manuscript", "print"): (["manuscript"], ["paper"]),
}
#: Names of game platforms that are not spelled like others (fixed values).
PLATFORMS = {
    "3ds": "3DS", "ds": "DS", "gamecube": "GameCube", "game cube": "GameCube", "nes": "NES", "new 3ds": "New 3DS", "ps": "PS", "ps1": "PS", "playstation": "PS", "ps2": "PS2", "ps3": "PS3",
    "ps3 move": "PS3 Move", "ps4": "PS4", "ps4 deluxe": "PS4 Deluxe", "ps4 vr": "PS4 VR", "ps5": "PS5", "psp": "PSP", "psvita": "PSVita", "ps vita": "PSVita", "snes": "SNES",
}
#: Labels of formats (fixed values).
FORMAT_LABELS = {
    "game_handheld_cartridge": "Game Cartridge", "game_console_cartridge": "Game Cartridge", "cdrom": "CD-ROM", "game_handheld_cdrom": "Game CD-ROM", "game_console_cdrom": "Game CD-ROM",
    "game_computer_cdrom": "Game CD-ROM", "tarot": "Tarot Cards", "online": "Online", "digital": "Digital File", "digital_device": "Digital Device", "16mmfilm": "16mm Film", "dvd": "DVD", "bluray": "Blu-ray",
    "filmstrip": "Filmstrip", "laserdisc": "Laserdisc", "vhs": "VHS", "slide": "Slide", "streaming": "Online", "microfiche": "Microfiche", "microfilm": "Microfilm", "microopaque": "Microopaque",
    "print": "Print/Paper", "paper": "Paper", "largeprint": "Large-Print/Paper", "braille": "Braille", "record": "Record", "record_78rpm": "78 RPM", "record_7inch": "7-inch Vinyl",
    "record_10inch": "10-inch Vinyl", "record_12inch": "12-inch Vinyl", "cd": "CD", "cassette": "Cassette",
}
#: Categories of a resource by its types (fixed values).
TYPE_CATEGORIES = {
    "book": ["books"], "database": ["online_databases"], "score": ["music_scores"], "map": ["maps"], "video": ["video_film"], "film": ["video_film"], "filmstrip": ["video_film"],
    "slide": ["video_film"], "audio": ["audio"], "music": ["music_recordings"], "spoken": ["spoken_recordings"], "graphic": ["images"], "software": ["software"],
    "game": ["games"], "computer": ["software"], "console": ["software"], "handheld": ["software"], "ebook": ["books"], "kit": ["educational_kits"],
    "archive": ["archives_manuscripts"], "journal": ["journals_periodicals"], "object": ["objects_artifacts"], "tabletop": ["objects_artifacts"],
    "equipment": ["equipment", "objects_artifacts"], "manuscript": ["books", "archives_manuscripts"], "ejournal": ["journals_periodicals"],
    "newspaper": ["journals_periodicals", "newspapers"], "thesis": ["theses_dissertations"],
}
#: Media of a resource by its types together, each type and each format (fixed values).
MEDIA = {
    "cassette": ["Audio Cassette Tapes"], "cd": ["Audio CDs"], "record": ["Audio Records (LPs/EPs)"], "streaming": ["Digital Files"], "audio_computer": ["Digital Files"],
    "document": ["Digital Files"], "database": ["Digital Files"], "ebook": ["Digital Files"], "ejournal": ["Digital Files"], "software": ["Computer Programs (not Games)"],
    "game_computer": ["Computer Games"], "game_console": ["Console Games"], "game_handheld": ["Handheld Games"], "game_computer_cdrom": ["Computer Games"],
    "game_console_cdrom": ["Console Games"], "game_handheld_cdrom": ["Handheld Games"], "game_console_cartridge": ["Console Games"], "game_handheld_cartridge": ["Handheld Games"],
    "dvd": ["DVDs"], "bluray": ["Blu-ray Discs"], "filmstrip": ["Filmstrips"], "laserdisc": ["Laserdiscs"], "vhs": ["VHS Tapes"], "slide": ["Slides"],
    "game_tabletop": ["Tabletop Games"], "tarot": ["Tarot Cards"], "manuscript": ["Manuscripts"], "archive": ["Archival Collections"], "record_78rpm": ["78 RPM Records"],
    "record_7inch": ["7-inch Vinyl Records"], "record_10inch": ["10-inch Vinyl Records"], "record_12inch": ["12-inch Vinyl Records"],
    "digital_device": ["Audiobook Devices", "Digital Files"], "cdrom": ["CD-ROMs"], "16mmfilm": ["16mm Film"], "print": ["Paper"], "paper": ["Paper"],
    "digital": ["Digital Files"], "largeprint": ["Paper", "Large Print"], "braille": ["Paper", "Braille"], "microfiche": ["Microforms", "Microfiche"],
    "microfilm": ["Microforms", "Microfilm"], "microopaque": ["Microforms", "Microopaques"],
}
_STRINGS = "array<string>"


def _looked_up(table: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _among(a: Column, values: Iterable[str]) -> Column:
    return F.arrays_overlap(a, F.array(*map(F.lit, values)))


def _in_all(table: Mapping[str, Sequence[str]], keys: Column) -> Column:
    """What a table of lists holds of any of the keys, as one array."""
    packed = {k: "|".join(v) for k, v in table.items()}
    return F.flatten(_known(F.transform(keys, lambda k: F.split(_looked_up(packed, k), r"\|"))))


def _title(text: Column) -> Column:
    """Every run of letters with a capital in front."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _format_007(x: Column) -> Column:
    first = F.substring(x, 1, 3)
    later = [F.when(first == start, _looked_up(table, F.substring(x, at + 1, len(next(iter(table)))))) for start, at, table in LATER_007]
    return F.coalesce(_looked_up(FORMATS_007, first), *later)


def resource_type_info(bibs: DataFrame) -> DataFrame:
    """``bibs`` with resource_type, resource_type_categories and media_type_categories.

    ``bibs`` has bcode2, f007s and f008s (arrays of control fields),
    call_numbers (the bib's, then its unsuppressed items') and locations.
    Nulls count as nothing: an unknown type, empty arrays.
    """
    empty = F.array().cast(_STRINGS)
    d = bibs.withColumns({f"_{c}": F.coalesce(c, empty) for c in ("f007s", "f008s", "locations")}).withColumn("_cns", F.transform(F.coalesce("call_numbers", empty), F.lower))
    d = d.withColumn("_own", F.coalesce(_looked_up(BASE_TYPES, F.col("bcode2")), F.lit("unknown")))
    news = F.col("_own").isin(*NEWSPAPER_TYPES) & F.exists("_f008s", lambda x: F.substring(x, 22, 1) == NEWSPAPER_BYTE)
    d = d.withColumn("_news", news).withColumn("_base", F.when(F.col("_news"), "newspaper").otherwise(F.col("_own")))
    base, paper = F.col("_base"), F.col("_base").isin(*PAPER_TYPES)
    of_008 = F.when(paper, _known(F.transform("_f008s", lambda x: _looked_up(FORMATS_008, F.substring(x, 24, 1))))).otherwise(empty)
    of_007 = F.when(~base.isin(*ONLINE_TYPES, "object"), _known(F.transform("_f007s", _format_007))).otherwise(empty)
    as_online = F.when(F.col("_news") & F.col("_own").isin(*ONLINE_TYPES), F.array(F.lit("online"))).otherwise(empty)
    d = d.withColumn("_found", F.array_sort(F.array_distinct(F.concat(as_online, of_008, of_007))))
    d = d.withColumn("_found", F.when(paper & (F.size("_found") == 0), F.array(F.lit("print"))).otherwise(F.col("_found")))
    together = _looked_up({"+".join(k): v for k, v in TOGETHER.items()}, F.array_join("_found", "+"))
    d = d.withColumn("_found", F.when(together.isNotNull(), F.array(together)).otherwise(F.col("_found")))
    pair = F.when(F.size("_found") <= 1, F.concat_ws("|", base, F.get("_found", 0)))
    types, formats = (_looked_up({"|".join(k): " ".join(v[i]) for k, v in TYPE_FORMATS.items()}, pair) for i in (0, 1))
    d = d.withColumns({"_types": F.when(types.isNotNull(), _words(types)).otherwise(empty), "_formats": F.when(types.isNotNull(), _words(formats)).otherwise(F.col("_found"))})

    # Films: music on disc or tape by the first such call number.
    music = F.get(F.filter("_cns", lambda n: n.startswith("mdvd") | n.startswith("mvc")), 0)
    of_film = F.when((F.size("_formats") <= 1) & music.isNotNull(), F.array(F.lit("video"), F.lit("music"), F.when(music.startswith("mdvd"), "dvd").otherwise("vhs")))
    # Games: console and handheld ones show their platforms in place of the medium.
    consoles, handhelds = ("game_console_cartridge", "game_console_cdrom"), ("game_handheld_cartridge", "game_handheld_cdrom")
    d = d.withColumns({"_console": (F.array_join("_types", "_") == "game_console") | _among(F.col("_formats"), consoles), "_handheld": (F.array_join("_types", "_") == "game_handheld") | _among(F.col("_formats"), handhelds)})
    name = lambda n: F.when(n.startswith("game"), F.nullif(F.regexp_extract(n, "^[^ ]* [^ ]* (.*)$", 1), F.lit(""))).when(n.contains(" game "), F.regexp_extract(n, "^.*? game (.*)$", 1))
    platforms = F.array_distinct(F.transform(F.array_distinct(_known(F.transform("_cns", name))), lambda p: F.coalesce(_looked_up(PLATFORMS, p), _title(p))))
    d = d.withColumn("_platforms", F.filter(platforms, lambda p: p != ""))
    played = F.col("_console") | F.col("_handheld")
    media_left = F.when(F.size("_platforms") == 0, F.col("_formats")).otherwise(
        F.filter("_formats", lambda f: ~((F.col("_console") & f.isin(*consoles)) | (F.col("_handheld") & f.isin(*handhelds))))
    )
    no_game = ~F.array_contains("_types", "game") & ~F.array_contains("_formats", "game_computer_cdrom")
    software = F.coalesce(F.get(_known(F.transform("_f008s", lambda x: _looked_up(SOFTWARE_008, F.substring(x, 27, 1)))), 0), F.lit("document"))
    of_software = F.when(F.col("_console") & F.col("_handheld"), F.array(F.lit("game"), F.lit("console"))).when(played, F.col("_types")).when(no_game, F.array(software, F.lit("computer"))).otherwise(F.col("_types"))
    # Objects: games of boards and cards, artefacts of one location, else equipment.
    tarot = F.exists("_cns", lambda n: n.endswith(" tarot"))
    board = tarot | F.exists("_cns", lambda n: n.startswith("boardgame") | n.endswith(" game"))
    of_object = F.when(board, F.array(F.lit("game"), F.lit("tabletop"))).when(F.array_contains("_locations", "w4spe"), F.array(F.lit("object"))).otherwise(F.array(F.lit("equipment")))
    is_software, is_object = base == "software", base == "object"
    d = d.withColumns(
        {
            "_types": F.when(base == "video_film", F.coalesce(of_film, F.col("_types"))).when(is_software, of_software).when(is_object, of_object).otherwise(F.col("_types")),
            "_formats": F.when(is_software & played, F.concat(media_left, F.col("_platforms"))).when(is_object & tarot, F.array_append("_formats", F.lit("tarot"))).otherwise(F.col("_formats")),
        }
    )
    d = d.withColumns({"_types": F.when(F.size("_types") == 0, F.split(base, "_")).otherwise(F.col("_types")), "_formats": F.array_sort(F.array_distinct("_formats"))})
    said = F.array_join("_types", "_")
    labels = F.array_join(F.transform("_formats", lambda f: F.coalesce(_looked_up(FORMAT_LABELS, f), f)), ", ")
    games = F.when(
        said.isin("game_console", "game_handheld") | _among(F.col("_types"), ("software", "computer")),
        F.transform(F.filter("_formats", lambda f: _looked_up(FORMAT_LABELS, f).isNull()), lambda f: F.concat(f, F.lit(" Games"))),
    ).otherwise(empty)
    files = F.when(F.array_contains("_formats", "online") & ~F.array_contains("_types", "software"), F.array(F.lit("Digital Files"))).otherwise(empty)
    media = F.concat(_in_all(MEDIA, F.concat(F.array(said), F.col("_formats"), F.col("_types"))), games, files)
    out = d.withColumns(
        {
            "resource_type": F.when(labels == "", said).otherwise(F.concat(said, F.lit("!"), labels)),
            "resource_type_categories": F.array_sort(F.array_distinct(_in_all(TYPE_CATEGORIES, F.col("_types")))),
            "media_type_categories": F.array_sort(F.array_distinct(media)),
        }
    )
    return out.select(*bibs.columns, "resource_type", "resource_type_categories", "media_type_categories")
