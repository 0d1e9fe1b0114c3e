import pytest

from siftline.operators import rules
from siftline.session import cut
from siftline.sources import parse

C = """#include <stdio.h>
void copy(char *in) {
    char buf[8];
    strcpy(buf, in);
    gets(buf);
    sprintf(buf, "%s", in);
    scanf("%s", buf);
    scanf("%7s", buf);
    printf(in);
    printf("%d", 1);
    system(in);
    memcpy(buf, in, 8);
    memcpy(buf, in, sizeof(buf));
    char *p = malloc(4);
    free(p);
    free(p);
    use(ptr);
}
void quiet(void) {
    system("ls");
}
int main(int argc, char **argv) { copy(argv[1]); return 0; }
"""
CPP = """#include <fstream>
void leak() {
    int *a = new int[n * m];
}
void kept() {
    auto a = std::make_unique<int>(new int);
    int *b = new int;
    delete b;
    b->use();
}
void nulls(int *q) {
    int x = 1;
    x = 2;
    x = 3;
    f(*q);
    char name[16];
    printf(name);
    printf("x");
    system(cmd);
    system("pause");
    std::ofstream out("a");
}
void safe(int *q) {
    delete q;
    q = nullptr;
    q->x();
}
"""
JAVA = """class A {
  void q(Statement s, String id) throws Exception {
    s.executeQuery("SELECT " + id);
    c.prepareStatement("SELECT ?" + id);
    DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();
    Runtime.getRuntime().exec("a" + id);
    Runtime.getRuntime().exec(id);
    String password = "hunter22";
    String passwd = "your_password";
    map.get(id).trim();
    SecretKeySpec k = new SecretKeySpec("abcdefgh".getBytes(), "AES");
    new File(base + id);
  }
  void r(ObjectInputStream in) { in.readObject(); }
  void s(String n) { File f = new File(n); f.getCanonicalPath(); }
}
"""
PY = """import os, pickle, subprocess
def run(cmd):
    eval(cmd)
    eval("1")
    pickle.loads(cmd)
    subprocess.call(cmd, shell=True)
    os.system(cmd)
    open(cmd)
    open('x')
    token = 'abcdefgh'
    token = 'example_token'
def quiet(p):
    return 1
"""
GO = """package main
import "os/exec"
var secret = "abcdefgh"
func main() {
	c := exec.Command("sh", "-c", os.Args[1])
	d := exec.Command("ls")
	x := unsafe.Pointer(&c)
	_ = run(c)
	v, _ := run(d)
	fmt.Printf(v)
	fmt.Printf("%s", v)
}
"""
EXPECTED = {
    "c": {("strcpy_overflow", 4), ("gets_unbounded_read", 5), ("sprintf_overflow", 6), ("scanf_unbounded_string", 7), ("format_string_injection", 6), ("format_string_injection", 9), ("command_injection", 11), ("command_injection", 20), ("memcpy_no_bounds", 12), ("double_free", 16), ("use_after_free", 16)},
    "cpp": {("memory_leak_raw_new", 3), ("integer_overflow_array_size", 3), ("use_after_delete", 9), ("nullptr_dereference_uncaught", 15), ("char_array_buffer_issue", 16), ("cpp_format_string_injection", 17), ("cpp_system_command_injection", 19), ("ofstream_incorrect_permissions", 21)},
    "java": {("sql_injection_string_concat", 3), ("xxe_document_builder_factory", 5), ("runtime_exec_command_injection", 6), ("runtime_exec_command_injection", 7), ("hardcoded_password_credential", 8), ("null_return_not_checked", 10), ("hardcoded_crypto_key", 11), ("path_traversal_new_file", 12), ("unsafe_deserialization_object_input_stream", 14)},
    "python": {("eval_exec_injection", 3), ("unsafe_deserialization", 5), ("subprocess_shell_injection", 6), ("os_system_injection", 7), ("path_traversal", 8), ("hardcoded_secret", 10)},
    "go": {("go_exec_command_injection", 5), ("go_osargs_no_validation", 5), ("go_unsafe_pointer", 7), ("go_ignored_error", 8), ("go_ignored_error", 9), ("go_fmt_sprintf_injection", 10), ("go_hardcoded_secret", 3)},
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("c", "c", C), ("cpp", "cpp", CPP), ("java", " Java", JAVA), ("py", "PYTHON", PY), ("go", "go", GO), ("none", "c", None), ("empty", "c", ""), ("other", "rust", "fn main() {}"), ("broken", "python", "def f(:\n  eval(x)\n")], "file string, lang string, text string")
    facts = cut(parse.facts(files, text="text", lang="lang", keep=("file",)))
    return rules.scan(files, facts, "file", "text").toPandas()


@pytest.mark.parametrize("language", sorted(EXPECTED))
def test_expected_findings(found, language):
    rows = found[found["file"] == {"python": "py"}.get(language, language)]
    assert set(zip(rows["rule_name"], rows["line"], strict=True)) == EXPECTED[language]


def test_severities_and_functions(found):
    at = {(r.file, r.rule_name, r.line): r for r in found.itertuples()}
    assert at["c", "command_injection", 11].severity == "CRITICAL"  # its function reads input
    assert at["c", "command_injection", 20].severity == "HIGH"
    assert at["c", "memcpy_no_bounds", 12].severity == "HIGH"  # raised: reachable and input from outside
    assert at["java", "runtime_exec_command_injection", 6].severity == "CRITICAL"
    assert at["py", "path_traversal", 8].confidence == 0.8
    assert at["go", "go_hardcoded_secret", 3].function_name == "unknown"
    assert at["c", "strcpy_overflow", 4].function_name == "copy"


def test_broken_files_give_what_their_lines_show(found):
    assert ("eval_exec_injection", 2) in set(zip(found[found["file"] == "broken"]["rule_name"], found[found["file"] == "broken"]["line"], strict=True))


def test_37_rules(spark):
    assert len(rules.registry()) + len(rules.OTHERS) == 37


def test_a_further_rule(spark):
    from pyspark.sql import functions as F

    rules.MORE.append(lambda: rules.Rule("no_goto", "c", ("call_expression",), "CWE-0", "goto", "INFO", 0.1, F.col("src").contains("goto")))
    try:
        assert any(r.name == "no_goto" for r in rules.registry())
    finally:
        rules.MORE.pop()


def test_dense_numbers(spark):
    rows = spark.createDataFrame([("c", i) for i in range(50)] + [("go", i) for i in range(3)], "lang string, k int")
    got = rules.numbered(rows, ["k"]).collect()
    assert sorted(r.vuln_id for r in got if r.lang == "c") == [f"SIFT-C-{i:03d}" for i in range(1, 51)]
    assert {r.k: r.vuln_id for r in got if r.lang == "go"} == {0: "SIFT-GO-001", 1: "SIFT-GO-002", 2: "SIFT-GO-003"}


def test_snippet(spark):
    rows = spark.createDataFrame([(1, 1, "a "), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")], "f int, line int, src string")
    got = {(r.f, r.line): r.code_snippet for r in rules.snippet(rows, ["f"]).collect()}
    assert got[1, 2] == "       1 | a\n>>>    2 | b\n       3 | c" and got[2, 1] == ">>>    1 | x"
