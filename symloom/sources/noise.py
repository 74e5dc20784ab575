"""Names of built-in and framework calls by language, which make no CALLS edges by name alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Results depend on these lists.
TYPESCRIPT = """
log error warn info debug trace push pop shift unshift splice slice map filter reduce forEach find findIndex some every flat flatMap sort reverse join concat includes indexOf lastIndexOf
split trim replace match startsWith endsWith charAt substring toLowerCase toUpperCase keys values entries assign freeze create stringify parse parseInt parseFloat isNaN isFinite isArray
resolve reject all allSettled race any then catch finally get set has delete clear add next return throw setTimeout clearTimeout setInterval clearInterval call apply bind length
createElement useState useEffect useRef useCallback useMemo useContext useReducer render
expect toBe toEqual toBeDefined toBeNull toBeUndefined toBeTruthy toBeFalsy toContain toHaveLength toThrow toHaveBeenCalled toHaveBeenCalledWith toMatchObject toHaveBeenCalledTimes toHaveProperty
describe it test beforeEach afterEach beforeAll afterAll fn spyOn mock mockResolvedValue mockReturnValue mockImplementation mockReturnThis
console Math Date JSON Object Array String Number Boolean Promise Error Map Set RegExp Buffer process require
"""
PYTHON = "print len range enumerate zip isinstance type super self cls None True False append extend insert remove update items format strip upper lower"
BASH = "source . echo printf read cd pwd export local declare readonly unset set shift return exit eval exec trap wait kill true false test type command getopts shopt break continue sleep ls cat cp mv rm mkdir rmdir touch ln chmod chown grep sed awk cut tr sort uniq head tail wc find xargs tee basename dirname realpath env date curl wget tar git make sudo"
C = "printf fprintf sprintf scanf malloc free memcpy memset strlen strcpy strcmp sizeof"
CSHARP = "Console WriteLine Write ToString Equals GetHashCode GetType"
DART = "print toString hashCode runtimeType noSuchMethod"
ELIXIR = "IO puts inspect Enum map filter reduce each to_string String Map List"
GO = "fmt Println Printf Sprintf Errorf make panic recover defer len cap append copy new close delete"
JAVA = "System println equals hashCode getClass toString"
KOTLIN = "println print listOf mapOf setOf listOfNotNull setOfNotNull arrayOf arrayListOf mutableListOf mutableMapOf mutableSetOf hashMapOf hashSetOf linkedMapOf linkedSetOf sortedMapOf sortedSetOf emptyList emptyMap emptySet let apply run also with require requireNotNull check checkNotNull error assert lazy lazyOf repeat synchronized TODO runCatching"
PHP = "echo print var_dump print_r isset empty count array_map array_filter array_reduce array_merge implode explode"
RUBY = "puts raise yield each do end attr_accessor attr_reader attr_writer respond_to new initialize render redirect_to before_action after_action validates has_many belongs_to has_one"
RUST = "println print eprintln eprint format write panic assert assert_eq assert_ne vec unwrap expect clone to_string to_owned into from"
SCALA = "println print Some None Option Seq List Map Set toString"
SWIFT = "print debugPrint dump String Int Double Array Dictionary Optional"

NOISE: dict[str, frozenset[str]] = {
    k: frozenset(v.split())
    for k, v in {"typescript": TYPESCRIPT, "tsx": TYPESCRIPT, "javascript": TYPESCRIPT, "python": PYTHON, "bash": BASH, "c": C, "cpp": C, "csharp": CSHARP, "dart": DART, "elixir": ELIXIR, "go": GO, "java": JAVA, "kotlin": KOTLIN, "php": PHP, "ruby": RUBY, "rust": RUST, "scala": SCALA, "swift": SWIFT}.items()
}


def register_noise(language: str, names) -> None:
    """Names for a further language, or in place of those of a known one."""
    NOISE[language] = frozenset(names)


def noise_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, names in sorted(NOISE.items()) for n in sorted(names)], "language string, name string")
