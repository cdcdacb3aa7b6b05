"""Scopes of source files against rows typed by hand."""

import pytest

from qaspark.operators import sourcecode
from qaspark.operators.scopes import closers, field_limits, fluent_rules, masked, scopes


def methods(code, language):
    return [(s.owner, s.name, s.type, s.parameters, s.body) for s in scopes(code, language) if s.kind == "method"]


CSHARP = '''
namespace Shop {
  // class Ghost { public void Not() { } }
  public class First : Base<int> {
    public async Task<Dictionary<string, List<int>>> Load(Func<int, int> f, string s = "a, ) {") {
      var text = @"verbatim "" } "; /* } */ char c = '}';
      if (s == null) { return null; }
      return null;
    }
    private int Twice(int x) => Wrap(x, "; }");
    public class Inner {
      public void Deep() { while (true) { } }
    }
    protected abstract void Later(int a);
    public T Pick<T>(T x) where T : class { return x; }
  }
  public class Second { public static string Name() { return $"{1}"; } }
}
'''


def test_csharp():
    assert methods(CSHARP, "csharp") == [
        ("First", "Load", "Task<Dictionary<string, List<int>>>", 'Func<int, int> f, string s = "a, ) {"', CSHARP[CSHARP.index("{\n      var") : CSHARP.index("\n    private")]),
        ("First", "Twice", "int", "int x", 'Wrap(x, "; }");'),
        ("Inner", "Deep", "void", "", "{ while (true) { } }"),
        ("First", "Later", "void", "int a", ""),
        ("First", "Pick", "T", "T x", "{ return x; }"),
        ("Second", "Name", "string", "", '{ return $"{1}"; }'),
    ]
    assert [(s.name, s.owner, s.bases) for s in scopes(CSHARP, "csharp") if s.kind == "class"] == [("First", "", "Base<int>"), ("Inner", "First", ""), ("Second", "", "")]


JAVA = '''
public class Api<T extends Map<String, List<T>>> extends Base implements A, B {
  /* public void no() { */
  @GetMapping("/x{id}")
  public Map<String, List<Integer>> find(@PathVariable("id") Long id, int n) throws IOException, Other {
    String s = "}\\"}"; char c = '{';
    return switch (n) { case 1 -> null; default -> { yield null; } };
  }
  protected final <R> R map(Function<T, R> f) { return f.apply(null); }
  private static class Row { private int n; public int get() { return n; } }
  public abstract void none();
}
class Other { public void a() { String t = """
   } public void fake() { }
   """; } }
'''


def test_java():
    assert [(o, n, t) for o, n, t, _, _ in methods(JAVA, "java")] == [
        ("Api", "find", "Map<String, List<Integer>>"),
        ("Api", "map", "R"),
        ("Row", "get", "int"),
        ("Api", "none", "void"),
        ("Other", "a", "void"),
    ]
    bodies = {n: b for _, n, _, _, b in methods(JAVA, "java")}
    assert bodies["find"].endswith("yield null; } };\n  }") and bodies["get"] == "{ return n; }" and bodies["none"] == "" and bodies["a"].endswith('"""; }')


PYTHON = '''
class Item(BaseModel):
    name: str = Field(..., min_length=2, max_length=5, description="ge=9, le=(")
    size: int = Field(0, ge=1, le=10)
    free: str = Field("x")
    code: str = Field(regex=r"^[a-z),]+$")

    def check(self, text: str = "def fake():", n: Dict[str, int] = {}) -> List[int]:
        """def doc():
class NotHere:
        """
        # def comment(self): pass
        def inner(x):
            return x
        return [inner(n)]

    async def later(
        self,
    ):
        return 1

def free(): return 5
class Empty(Item): pass
'''


def test_python():
    got = methods(PYTHON, "python")
    assert [(o, n, t, p) for o, n, t, p, _ in got] == [
        ("Item", "check", "List[int]", 'self, text: str = "def fake():", n: Dict[str, int] = {}'),
        ("Item", "inner", "", "x"),
        ("Item", "later", "", "self,"),
        ("", "free", "", ""),
    ]
    bodies = {n: b for _, n, _, _, b in got}
    assert bodies["check"].endswith("return [inner(n)]") and bodies["inner"] == "            return x" and bodies["later"] == "        return 1" and bodies["free"].strip() == "return 5"
    body = next(s.body for s in scopes(PYTHON, "python") if s.name == "Item")
    assert field_limits(body) == [("name", "min_length(2),max_length(5)"), ("size", "ge(1),le(10)"), ("code", "regex(^[a-z),]+$)")]


CPP = '''
#include "crow.h"
struct Item { std::string name; };
class Store : public Base {
 public:
  std::map<int, std::vector<int>> all(const Item& i) const { return {}; }
  int later(int x);
};
int Store::later(int x) { if (x < 3) { return call("{"); } return 0; } // }
bool validateItem(const Item& i) {
  return check(i);
}
'''


def test_cpp():
    assert methods(CPP, "cpp") == [
        ("Store", "all", "std::map<int, std::vector<int>>", "const Item& i", "{ return {}; }"),
        ("", "Store::later", "int", "int x", '{ if (x < 3) { return call("{"); } return 0; }'),
        ("", "validateItem", "bool", "const Item& i", "{\n  return check(i);\n}"),
    ]


@pytest.mark.parametrize("language", ["csharp", "java", "python", "cpp"])
@pytest.mark.parametrize("code", [None, "", "}}}", "public void a() {", '"', "/*", "'''", "class A {", "class A:", "def f(", "public class B { public int C() { return 1;", "(" * 3000])
def test_broken_files(code, language):
    for s in scopes(code, language):
        assert s.name
    assert len(masked(code or "", language)) == len(code or "")


def test_masks_and_brackets():
    text = masked('a("b)", /* ( */ c)', "java")
    assert text == 'a("  ",         c)' and closers(text) == {1: 17}
    assert scopes("anything", "cobol") == []


def test_rules_belong_to_their_class(spark):
    code = """public class OneValidator : AbstractValidator<One> {
      public OneValidator() { RuleFor(x => x.Name).NotEmpty().Length(2, 5).Matches("a;b)").WithMessage("x (").Must(v => Ok(v)); } }
    public class TwoValidator : AbstractValidator<Two> { public TwoValidator() { RuleFor(y => y.Deep.Age)
      .GreaterThan(Min(1, 2))
      .When(y => y.On); /* RuleFor(x => x.Ghost).NotNull(); */ } }"""
    java = """class ItemDTO { @NotNull @Size(min = 1, max = 3)
      private String a; private int b; } class NextDTO { @Deprecated private int c; @Min(3) private Long d; }"""
    python = 'class M(BaseModel):\n    a: int = Field(gt=0)\n    @validator("a", pre=True)\n    def fix(cls, v):\n        return v\n    @root_validator(pre=True)\n    def whole(cls, v):\n        return v\n'
    files = spark.createDataFrame([("a.cs", "csharp", code), ("b.java", "java", java), ("c.py", "python", python), ("d.cs", "csharp", None)], "path string, language string, code string")
    assert {tuple(r) for r in sourcecode.validators_inventory(files).collect()} == {
        ("a.cs", "OneValidator", "Name", 'NotEmpty,Length(2, 5),Matches("a;b)"),WithMessage("x ("),Must(v => Ok(v))'),
        ("a.cs", "TwoValidator", "Age", "GreaterThan(Min(1, 2)),When(y => y.On)"),
        ("b.java", "ItemDTO", "a", "NotNull,Size(min = 1, max = 3)"),
        ("b.java", "NextDTO", "d", "Min(3)"),
        ("c.py", "M", "a", "gt(0)"),
        ("c.py", "M", "a", "custom:fix"),
        ("c.py", "M", "", "custom:whole"),
    }
    assert fluent_rules("RuleFor(1);") == []


def test_checks_and_routes(spark):
    cpp = 'web::http::experimental::listener::http_listener listener(U("http://localhost:8080/api/items/"));\nlistener.support(methods::GET, get);\nlistener.support(methods::DEL, "/own", del);\nother.support(methods::POST, f);'
    csharp = 'public class A { public void B() { Log("if (x == null)"); } public void C() { if (s.Length == 0) { } } }'
    files = spark.createDataFrame([("a.cpp", "cpp", cpp), ("a.cs", "csharp", csharp)], "path string, language string, code string")
    assert {tuple(r)[1:] for r in sourcecode.endpoints_cpp(files).collect()} == {("cpprest", "GET", "/api/items"), ("cpprest", "DELETE", "/own"), ("cpprest", "POST", "/")}
    assert {tuple(r)[1:] for r in sourcecode.inline_validations(files).collect()} == {("B", ""), ("C", "empty_check")}


def test_a_registered_parser_takes_its_language(spark, monkeypatch):
    monkeypatch.setattr(sourcecode, "PARSERS", dict(sourcecode.PARSERS))
    sourcecode.register_parser("go", lambda files: files.selectExpr("path", "'GET' AS http_method", "code AS route"))
    files = spark.createDataFrame([("a.go", "go", "/go"), ("b.py", "python", "@app.get('/py')\ndef f():\n  pass")], "path string, language string, code string")
    assert {tuple(r) for r in sourcecode.all_endpoints(files).collect()} == {("a.go", "go", "GET", "/go"), ("b.py", "python", "GET", "/py")}
