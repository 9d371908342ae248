"""Fixed default values.

Every value here must equal the published behaviour this library reproduces.
They are all arguments of the operators, so another corpus can bring its own.
"""

# Label name -> three-letter code used in generated ids.
LABEL_CODES = {
    "Surprise": "SPR",
    "Proud": "PRD",
    "Trust": "TRT",
    "Sad": "SAD",
    "Joy": "JOY",
    "Anger": "ANG",
    "Fear": "FEA",
    "Neutral": "NEU",
    "Love": "LOV",
    "Loyalty": "LOY",
}

# Indonesian function words left out before phrases are built.
STOPWORDS = tuple(
    """
    yang dan di ke dari ini itu ada untuk dengan atau pada dalam jadi akan sudah udah telah bisa
    dapat tidak gak ga nggak enggak ya iya saya aku kami kita kamu lu lo gue dia mereka apa siapa
    mana bagaimana kenapa kalau kalo karena tapi namun juga lagi lebih sangat banget sama seperti
    kayak gitu begitu tuh nih kan kok sih dong deh lah pun saja aja masih belum pernah harus mau
    ingin boleh buat pakai pake terus dulu tadi nanti sekarang ketika saat setiap sebuah seorang
    orang hal nya
    """.split()
)

# Routing of a URL host to a source code. A rule is
# (source code, "equals" | "contains", host text); the first match wins.
HOST_RULES = (
    ("GD", "equals", "drive.google.com"),
    ("IG", "contains", "instagram.com"),
    ("IG", "contains", "cdninstagram.com"),
    ("IG", "contains", "instagram."),
)
UNSUPPORTED = "UNSUPPORTED"

# Patterns whose first group is a shared-drive file id, tried in order.
DRIVE_ID_PATTERNS = (r"/file/d/([^/]+)", r"[?&]id=([^&]+)")

# Fragments of a download error that mean "the file is gone",
# the note published for them, and the note for an error without a message.
ERROR_RULES = {
    "GD": {
        "markers": (
            "cannot retrieve the public link",
            "file not found",
            "permission",
            "access denied",
            "quota",
            "404",
            "403",
        ),
        "unavailable": "google drive file deleted/unavailable/private",
        "fallback": "gdown failed",
    },
    "IG": {
        "markers": (
            "unavailable",
            "not available",
            "private",
            "login required",
            "requested content is not available",
            "this video has been deleted",
            "unable to extract",
            "404",
            "403",
        ),
        "unavailable": "instagram video deleted/unavailable/private",
        "fallback": "yt-dlp failed",
    },
}

# Notes and columns of the ingest ledger.
UNSUPPORTED_NOTE = "Only Instagram and Google Drive sources are allowed"
NO_DRIVE_ID_NOTE = "google drive file id could not be parsed"
LEDGER_COLUMNS = (
    "dataset_id",
    "video_id",
    "emotion",
    "url",
    "source_type",
    "status",
    "has_raw_transcript",
    "has_cleaned_transcript",
    "transcription_method",
    "raw_transcript_path",
    "cleaned_transcript_path",
    "notes",
)

# The four model configurations (name, shortest and longest phrase, stopwords removed).
EXPERIMENTS = (
    ("unigram", (1, 1), False),
    ("stopwords", (1, 1), True),
    ("bigram", (1, 2), True),
    ("trigram", (1, 3), True),
)
