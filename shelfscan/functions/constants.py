"""Fixed values of the data model: results depend on them."""

MAX_TEXT_CHARS = 400_000
MAX_FILE_BYTES = 300 * 1024 * 1024
MAX_PART_BYTES = 32 * 1024 * 1024
MAX_ARCHIVE_NAMES = 20_000
PARTIAL_BYTES = 16 * 1024
SIMHASH_MIN_CHARS, SIMHASH_MAX_CHARS = 200, 100_000
NEAR_DISTANCE, IMAGE_DISTANCE = 3, 10
DHASH_NONE, DHASH_FLAT_BITS = -(1 << 63), 8
HOT_BUCKET = 2000
OCR_FEW_CHARS = 100
EXTRACT_VERSION = 2
CLOUD_MASK = 0x1000 | 0x40000 | 0x400000

# Extensions by treatment.
DOCUMENT_EXTS = ".pdf .docx .docm .xlsx .xlsm .pptx .pptm .rtf .epub .odt .ods .odp .doc .xls .ppt .eml .zip .cbz".split()
MESSAGE_EXTS = [".msg"]
AUDIO_EXTS = ".mp3 .m4a .m4b .aac .flac .ogg .opus .wma .wav .aiff .mp4 .m4v .mov".split()
IMAGE_EXTS = ".png .jpg .jpeg .tif .tiff .bmp .gif .webp .heic .heif".split()
TEXT_EXTS = ".txt .md .csv .tsv .log .json .xml .html .htm .ini .cfg .conf .yml .yaml .py .js .ts .css .c .h .cpp .cs .java .sql .ps1 .bat .cmd .sh".split()
INDEXABLE_EXTS = DOCUMENT_EXTS + TEXT_EXTS + MESSAGE_EXTS + AUDIO_EXTS
REEXTRACT_EXTS = ".docx .docm .xlsx .xlsm .pptx .pptm .odt .ods .odp .epub".split()

# The families of the type filter.
TYPE_GROUPS = {
    "images": ".jpg .jpeg .png .gif .webp .bmp .tif .tiff .heic .heif .svg .ico .raw .cr2 .nef .arw .dng .psd".split(),
    "videos": ".mp4 .mkv .avi .mov .wmv .m4v .webm .flv .mpg .mpeg .ts .3gp .vob".split(),
    "audio": ".mp3 .m4a .m4b .aac .flac .ogg .opus .wma .wav .aiff .mid .midi".split(),
    "documents": ".pdf .doc .docx .docm .xls .xlsx .xlsm .ppt .pptx .pptm .odt .ods .odp .rtf .txt .md .epub .pages .numbers .key .csv".split(),
    "compressed": ".zip .rar .7z .gz .bz2 .xz .tar .cbz .cbr .iso .dmg".split(),
    "code": ".py .js .ts .html .htm .css .c .h .cpp .cs .java .sql .sh .bat .cmd .ps1 .json .xml .yml .yaml .ini .cfg .lua .gd".split(),
    "programs": ".exe .msi .app .dll .apk .deb .pkg".split(),
    "emails": ".eml .msg".split(),
}

# Folders that are never walked, by lower-case name, besides all that begin with a dollar sign.
SKIP_DIRS = [
    "windows", "program files", "program files (x86)", "programdata", "$recycle.bin", "system volume information", "recovery", "perflogs",
    "node_modules", "__pycache__", ".git", ".svn", ".hg", ".venv", "venv", ".venv-win", ".venv-mac", ".venv-linux", "env", "site-packages",
    "appdata", ".cache", ".gradle", ".nuget", "windowsapps", "msocache",
]

# The columns of the index; others of a table are left out where they could clash.
FILE_COLUMNS = "id path name ext size mtime indexed chars status error is_dir phash fhash kind simhash dhash".split()
