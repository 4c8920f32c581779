"""Pattern tables of the title, identity and source rules."""

from __future__ import annotations

import itertools
import re

BOUNDARY = r"\b"

# Presentation words of a video title, removed in this order.
PRESENTATION = [
    r"\[20\d\d\s+festa\]", r"#\S+", r"\bofficial\s+music\s+video\b", r"\bofficial\s+video\b", r"\bofficial\s+audio\b",
    r"\bofficial\s+lyric\s+video\b", r"\bofficial\s+m\s*/?\s*v\b", r"\bcolor\s+coded(?:\s+lyrics?)?\b",
    r"\b(?:eng|rom|han|kan|kor|jpn|가사)(?:\s*[/|,_]\s*(?:eng|rom|han|kan|kor|jpn|sub|가사))+\b",
    r"\b(?:vietsub|engsub|korsub|eng\s+sub|kor\s+sub|日本語字幕)\b", r"\blyric\s+video\b", r"\blyrics?\b", r"\b가사\b",
    r"\baudio\b", r"\bvisualizer\b", r"\bm\s*/\s*v\b", r"\bmv\b", r"\bmusic\s+video\b", r"\bhq\b", r"\b4k\b", r"\bfull\s+hd\b", r"\bhd\b",
]

# Empty brackets, dropped afterwards.
EMPTY_BRACKETS = [r"\(\s*\)", r"\[\s*\]", r"「\s*」"]

# An artist's name before a title, tried in this order; {artist} stands for the literal name.
ARTIST_PREFIX = [
    r"{artist}\s*(?:\([^()]*\))?\s*[-–—|:_]\s*",
    r"{artist}\s*(?:,|&|\band\b|\bx\b|\bft\b\.?|\bfeat(?:uring)?\b\.?)[^-–—|:_]*[-–—|:_]\s*",
    r"[^-–—|:_()]*\(\s*{artist}\s*\)\s*[-–—|:_]\s*",
    r"""{artist}\s*(?:\([^()]*\)|\s+[가-힣]+(?:\s+\d+)?)?\s*(?=['"‘“])""",
    r"{artist}\s+(?=[A-Za-z0-9가-힣])",
]

# An artist's name behind a title.
ARTIST_SUFFIX = r"\s*[-–—|:@]\s*{artist}(?=\s*$|\s*[\(\[])"

# Quoted parts of a title.
QUOTES = [
    r"(?:^|(?<=\s))['‘]((?:\w['’]\w|[^'’])+?)['’]+(?=\s|$)",
    r"['‘]([^'’]+)['’]",
    r"""["“]([^"”]+)["”]""",
    r"〈([^〉]+)〉",
]

# A title in two scripts, and a name followed by its other-script form in brackets.
TWO_SCRIPTS = r"^\s*([가-힣]+(?:\s+[가-힣]+)*)\s+([A-Za-z0-9\s'’&:!?-]+?)\s*$"
SCRIPT_PAIRS = [
    r"([A-Za-z0-9\s'’&:!?-]+?)\s*\(\s*([가-힣]+(?:\s+[가-힣]+)*)\s*\)",
    r"([가-힣]+(?:\s+[가-힣]+)*)\s*\(\s*([A-Za-z0-9\s'’&:!?-]+?)\s*\)",
]

# Feature credits.
FEATURE = [r"\bfeat(?:uring)?\b\.?", r"\bft\b\.?", r"\bwith\b", r"\bprod\b\.?", r"\bproduced\s+by\b"]

# Version tags and the patterns that give them.
VERSION = {
    "remix": [r"\bremix\b", r"\bmega\s*mix\b"],
    "live": [
        r"\blive\b", r"\bperforms\b", r"\bunplugged\b", r"\b라이브\b", r"\b공연\b", r"\b무대\b", r"\bspecial\s+stage\b",
        r"\bcomeback\s+(?:special\s+)?stage\b", r"\blate\s+show\b", r"\btonight\s+show\b", r"\btoday\s+show\b", r"\bjimmy\s+fallon\b",
        r"\bellen\s+degeneres\s+show\b", r"\bplayathome\b", r"\bsketchbook\b", r"\binkigayo\b", r"\b인기가요\b", r"\bm\s*countdown\b",
        r"\b엠카운트다운\b", r"\bmusic\s*core\b", r"\bmusic\s*bank\b", r"\bshow\s+music\b", r"\bimmortal\s+songs?\b", r"\bopen\s+mic\b",
        r"\btiny\s+desk\b", r"\bfestival\b", r"\bmuster\b", r"\bworld\s+premiere\b", r"\b(?:mma|mama)\s*20\d\d\b",
        r"\b20\d\d\s*(?:mma|mama|sbs|kbs|mbc)\b", r"\bgrammy(?:\s+awards|\b)", r"\b(?:amas|vmas|bbmas)\b", r"\biheart(?:radio)?\b",
        r"@\s*(?:music\s+blood|the\s+tonight|the\s+\d+th|show|인기가요|7dream|sy\s+in|beyond\s+live|nct\s+127\s+world)",
        r"\bprime\s+day\s+show\b",
    ],
    "fancam": [r"\bfancam\b", r"\b직캠\b", r"\b예능연구소\b"],
    "studio_choom": [r"\bbe\s+original\b", r"\bstudio\s+choom\b"],
    "special_clip": [r"\bspecial\s+clip\b", r"\b스페셜클립\b"],
    "track_video": [r"\btrack\s+video\b"],
    "teaser": [r"\bprologue\b", r"\bteaser\b"],
    "documentary": [r"\bdocumentary\b"],
    "full_album": [r"\bfull\s+album\b"],
    "playlist": [r"\bplaylist\b"],
    "concert": [r"\bconcert\b"],
    "tour": [r"\btour\b"],
    "acoustic": [r"\bacoustic\b"],
    "instrumental": [r"\binstrumental\b", r"\binst\.?(?=\s*$|\s*[\)\]])"],
    "sped_up": [r"\bsped\s*up\b"],
    "slowed": [r"\bslowed\b"],
    "reverb": [r"\breverb\b"],
    "nightcore": [r"\bnightcore\b"],
    "8d_audio": [r"\b8d\b"],
    "dance_practice": [
        r"\bdance\s+practice\b", r"\bdance\s+ver\.?\b", r"\bdance\s+performance\b", r"\bdance\s+mirror(?:ed)?\b", r"\bchoreography\b",
        r"\b안무영상\b",
    ],
    "stage_mix": [r"\b교차편집\b", r"\bstage\s+mix\b"],
    "performance_ver": [
        r"\bstage\s+ver\.?\b", r"\bperformance\s+ver\.?\b", r"\bperformance\s+video\b", r"\bspecial\s+performance\b",
        r"\bofficial\s+performance\b", r"\bperformance\b",
    ],
    "band_ver": [r"\bband\s+(?:live\s+)?ver\.?\b"],
    "english_ver": [r"\benglish\s+ver\.?\b"],
    "japanese_ver": [r"\bjapanese\s+ver\.?\b"],
    "midnight_ver": [r"\bmidnight\s+version\b"],
    "clean_ver": [r"\bclean(?:\s*[-/]\s*lyric|\s+version)?\b", r"\bnicer\b"],
    "extended": [r"\bextended(?:\s+version|\s+ver\.?)?\b"],
    "loop": [r"\b\d+\s*hours?\b", r"\bloop\b"],
    "taylors_version": [r"\btaylor['’]s\s+version\b"],
}
LIVE_FAMILY = ["live", "concert", "tour", "performance_ver", "band_ver"]

# Words that make a bracket or a title ending metadata.
METADATA = [
    r"\bfeat(?:uring)?\b\.?", r"\bft\b\.?", r"\bprod\b\.?", r"\bproduced\s+by\b", r"\bremix\b", r"\blive\b", r"\bacoustic\b",
    r"\binstrumental\b", r"\bversion\b", r"\bedit\b", r"\bextended\b", r"\bradio\b", r"\bsped\s*up\b", r"\bslowed\b", r"\breverb\b",
]

# Language versions and their canonical form, then soundtrack notes to drop.
CANONICAL = [
    (r"\b(?:japanese\s+ver(?:sion)?\.?|japan\s+ver(?:sion)?\.?|jp\s+ver(?:sion)?\.?)\b", "japanese ver"),
    (r"\b(?:english\s+ver(?:sion)?\.?|eng\s+ver(?:sion)?\.?)\b", "english ver"),
    (r"\b(?:korean\s+ver(?:sion)?\.?|kr\s+ver(?:sion)?\.?)\b", "korean ver"),
    (r"\|[^|]*(?:soundtrack|ost)\b.*$", " "),
    (r"[\(\[][^\(\)\[\]]*\b(?:soundtrack|ost)\b[^\(\)\[\]]*[\)\]]", " "),
]

# Words no remixer name is made of.
REMIX_STOP = ["remix", "version", "ver", "edit", "official", "audio", "video", "mv", "feat", "featuring", "ft", "with", "prod", "by"]

# Channels that publish for an artist.
AGENCY_CHANNELS = {
    "bts": ["bangtantv", "bighit music", "hybe labels"],
    "agust d": ["bangtantv", "bighit music", "hybe labels"],
    "v": ["bangtantv", "bighit music", "hybe labels"],
    "jungkook": ["bangtantv", "bighit music", "hybe labels"],
    "jimin": ["bangtantv", "bighit music", "hybe labels"],
    "jin": ["bangtantv", "bighit music", "hybe labels"],
    "rm": ["bangtantv", "bighit music", "hybe labels"],
    "j hope": ["bangtantv", "bighit music", "hybe labels"],
    "rosé": ["blackpink", "yg entertainment"],
    "lisa": ["blackpink", "yg entertainment", "lloud"],
    "jennie": ["blackpink", "yg entertainment"],
    "blackpink": ["yg entertainment"],
    "twice": ["jyp entertainment"],
    "nct u": ["smtown", "nct"],
    "nct dream": ["smtown", "nct dream"],
    "aespa": ["smtown"],
    "exo": ["smtown"],
    "shinee": ["smtown"],
    "taemin": ["smtown"],
    "iz one": ["stone music", "official iz one"],
    "brave girls": ["1thek", "brave entertainment"],
    "iu": ["이지금", "1thek", "edam"],
}

# Official and fan channel patterns.
OFFICIAL_CHANNEL = [
    r"\bofficial\b", r"\bentertainment\b", r"\brecords?\b", r"\blabels?\b", r"\bcontents?\b", r"\bmedia\b", r"\bproduction\b",
    r"\bsmtown\b", r"\bbangtantv\b", r"\b1thek\b", r"\bstarshiptv\b", r"\baomg\b", r"\b88rising\b", r"\bstone\s+music\b",
    r"\buniversal\s+music\b", r"\bsony\s+music\b", r"\bwarner\s+music\b", r"\bgenie\s+music\b", r"vevo$",
]
FAN_CHANNEL = [
    r"\bcrew\b", r"\bfan\b", r"\bbackup\b", r"\bleaks\b", r"\blyrics?\b", r"\bhype\b", r"\bvibes\b", r"\bclouds\b", r"\bclean\s+music\b",
    r"\bclean\s+audio\b", r"\bnew\s+music\b", r"\bsub\b", r"\bvietsub\b", r"\bengsub\b", r"\bcolor\s*coded\b", r"\barchive\b", r"\bchannel\b",
]

# Source named by the title, first match wins, and its downgrade on an unverified channel.
TITLE_SOURCE = [
    (r"\bofficial\s+music\s+video\b", "official_music_video"),
    (r"\bofficial\s+m\s*/?\s*v\b", "official_music_video"),
    (r"\bofficial\s+video\b", "official_video"),
    (r"\bofficial\s+audio\b", "official_audio"),
    (r"\bofficial\s+lyric\s+video\b", "official_lyric_video"),
    (r"\bofficial\s+live\s+(?:performance|video)\b", "official_live"),
    (r"\bofficial\s+performance\b", "official_live"),
    (r"\bvisualizer\b", "visualizer"),
    (r"\blyric\s+video\b", "lyric_video"),
    (r"\blyrics?\b", "lyrics"),
    (r"\bm\s*/\s*v\b", "music_video"),
    (r"\bmv\b", "music_video"),
]
DOWNGRADE = {
    "official_music_video": "music_video", "official_video": "music_video", "official_audio": "lyrics",
    "official_lyric_video": "lyric_video", "official_live": "lyrics",
}

# Weight of a source, sources that count as official.
SOURCE_PRIORITY = {
    "official_audio": 5, "topic_channel": 5, "official_lyric_video": 4, "official_channel": 3, "lyric_video": 3, "lyrics": 2,
    "official_music_video": 2, "official_video": 2, "music_video": 2, "visualizer": 2, "official_live": 1,
}
OFFICIAL_SOURCES = [
    "topic_channel", "official_channel", "official_audio", "official_lyric_video", "official_music_video", "official_video",
]


def branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside of any bracket."""
    parts, depth, i = [""], 0, 0
    while i < len(pattern):
        piece = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|.", re.DOTALL).match(pattern, i)[0]
        depth += (piece == "(") - (piece == ")")
        if piece == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += piece
        i += len(piece)
    return parts


def openings(pattern: str) -> str | None:
    """The characters a pattern that starts with \\b can go on with, as the inside of a class; None when they cannot be told."""
    if not pattern.startswith(BOUNDARY) or len(branches(pattern)) > 1:
        return None
    rest = pattern.removeprefix(BOUNDARY)
    if rest.startswith("(?:"):
        # the group ends where its bracket closes
        end = next(i for i in range(3, len(rest) + 1) if rest[i - 1] == ")" and rest[:i].count("(") == rest[:i].count(")"))
        options = [None] if rest[end:end + 1] in ("?", "*", "{") and rest[end:] else branches(rest[3 : end - 1])
    else:
        options = [rest]
    first = [re.match(r"(\\d|\w)(?![?*{])", part or "") for part in options]
    return "".join(dict.fromkeys(f[1] for f in first)) if all(first) else None


def quick(pattern: str) -> str:
    """The same pattern with a look at its first character before the word boundary, which costs far more to test."""
    first = openings(pattern)
    return pattern if first is None else f"(?=[{first}]){pattern}"


def any_of(patterns: list[str]) -> str:
    """Alternation in the given order; neighbours that start at a word boundary share its test."""
    parts = []
    for bounded, run in itertools.groupby(patterns, lambda p: openings(p) is not None):
        run = list(run)
        if bounded:
            first = "".join(dict.fromkeys(re.findall(r"\\d|\w", "".join(openings(p) for p in run))))
            parts.append(f"(?=[{first}])\\b(?:{'|'.join(p.removeprefix(BOUNDARY) for p in run)})")
        else:
            parts += run
    return "(?:" + "|".join(parts) + ")"


ANY_VERSION = any_of([p for patterns in VERSION.values() for p in patterns])
ANY_FEATURE = any_of(FEATURE)
ANY_METADATA = any_of(METADATA)
