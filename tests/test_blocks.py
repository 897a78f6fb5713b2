"""The blocks of a file in each language: node type, kind, names, first and last line."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators import blocks, chunking

FILES = {
    "python": (
        r'''import os

class A(Base):
    """Doc: class B: def no(): }"""

    @deco
    def m(self, x="def k():"):
        text = """
def inner():
    pass
"""
        return [
    1,
        ]

    async def n(self): pass
# def comment(): pass

def f():
    def g():
        return 1
    return g
x = 1
''',
        [
            ('class_definition', 'class', ['A'], 3, 16),
            ('function_definition', 'method', ['A.m'], 7, 14),
            ('function_definition', 'method', ['A.n'], 16, 16),
            ('function_definition', 'function', ['f'], 19, 22),
            ('function_definition', 'function', ['g'], 20, 21),
        ],
    ),
    "javascript": (
        r'''// function no() {}
export default async function go(a) {
  return '}' + `}${a}` + /[}]/.test(a);
}
class K extends B {
  constructor(x) { super(x); }
  static async run(y = {a: 1}) {
    if (y) { return 1; }
  }
  get size() { return 2 }
}
const add = (a, b) => a + b;
const big = async x => {
  return x;
};
list.map(v => v * 2);
''',
        [
            ('function_declaration', 'function', ['go'], 2, 4),
            ('class_declaration', 'class', ['K'], 5, 11),
            ('method_definition', 'method', ['K.constructor'], 6, 6),
            ('method_definition', 'method', ['K.run'], 7, 9),
            ('method_definition', 'method', ['K.size'], 10, 10),
            ('arrow_function', 'function', ['add'], 12, 12),
            ('arrow_function', 'function', ['big'], 13, 15),
            ('arrow_function', 'function', [], 16, 16),
        ],
    ),
    "typescript": (
        r'''export abstract class Repo<T> implements I {
  private async find(id: string): Promise<T> {
    return this.db.get(id);
  }
}
function id<T>(x: T): T { return x; }
const f = (a: number): number => a + 1;
interface I { a: string }
''',
        [
            ('class_declaration', 'class', ['Repo'], 1, 5),
            ('method_definition', 'method', ['Repo.find'], 2, 4),
            ('function_declaration', 'function', ['id'], 6, 6),
            ('arrow_function', 'function', ['f'], 7, 7),
        ],
    ),
    "tsx": (
        r'''export function App(props: P) {
  const click = () => { go("}"); };
  return <div onClick={click}>{props.a}</div>;
}
''',
        [
            ('function_declaration', 'function', ['App'], 1, 4),
            ('arrow_function', 'function', ['click'], 2, 2),
        ],
    ),
    "go": (
        r'''package main

type Point struct {
	X, Y int // }
}
type ID int

func (p *Point) Add(q Point) Point {
	return Point{p.X + q.X, p.Y + q.Y}
}

func main() {
	fmt.Println("}", `func x() {`)
}
''',
        [
            ('type_declaration', 'class', ['Point'], 3, 5),
            ('type_declaration', 'class', ['ID'], 6, 6),
            ('method_declaration', 'method', ['Point.Add'], 8, 10),
            ('function_declaration', 'function', ['main'], 12, 14),
        ],
    ),
    "rust": (
        r'''pub struct P<'a> { x: &'a str }
struct U(i32);
impl<'a> Show for P<'a> {
    fn show(&self) -> String {
        let c = '}'; let s = r#"fn no() {"#;
        format!("{}", self.x)
    }
}
trait T { fn sig(&self); }
pub async fn run() { /* } */ }
''',
        [
            ('struct_item', 'class', ['P'], 1, 1),
            ('struct_item', 'class', ['U'], 2, 2),
            ('impl_item', 'class', ['P'], 3, 8),
            ('function_item', 'method', ['P.show'], 4, 7),
            ('function_item', 'function', ['run'], 10, 10),
        ],
    ),
    "java": (
        r'''package a;
public class A<T> extends B {
    private int x = 1;
    A() { x = 2; }
    @Override
    public List<String> names(int n) throws E {
        String s = "}"; if (n > 0) { return null; }
        return new ArrayList<>();
    }
    interface I { void go(int a); }
}
''',
        [
            ('class_declaration', 'class', ['A'], 2, 11),
            ('method_declaration', 'method', ['A.names'], 6, 9),
            ('interface_declaration', 'class', ['A.I'], 10, 10),
            ('method_declaration', 'method', ['A.I.go'], 10, 10),
        ],
    ),
    "c": (
        r'''#include <x.h>
struct node { int v; struct node *next; };
static int add(int a, int b)
{
    char c = '}'; /* int no(void) { */
    return a + b;
}
void decl(int a);
''',
        [
            ('struct_specifier', 'class', ['node'], 2, 2),
            ('function_definition', 'function', ['add'], 3, 7),
        ],
    ),
    "cpp": (
        r'''namespace n {
class Box : public Base {
 public:
  Box(int w) : w_(w) {}
  int area() const { return w_; }
 private:
  int w_;
};
int Box::scale(int k) { auto s = R"(})"; return k; }
}
''',
        [
            ('class_specifier', 'class', ['Box'], 2, 8),
            ('function_definition', 'method', ['Box.Box'], 4, 4),
            ('function_definition', 'method', ['Box.area'], 5, 5),
            ('function_definition', 'function', ['Box::scale'], 9, 9),
        ],
    ),
    "ruby": (
        r'''# class No
module M
  class Dog < Animal
    def bark(n)
      n.times do |i|
        puts "end" if i > 0
      end
      text = <<~EOS
        def no
      EOS
      while n > 0 do
        n -= 1
      end
    end

    def quick = 1
    def ok?; true; end
  end
end
def top
  if true then 1 else 2 end
end
''',
        [
            ('class', 'class', ['Dog'], 3, 19),
            ('method', 'method', ['Dog.bark'], 4, 14),
            ('method', 'method', ['Dog.quick'], 16, 16),
            ('method', 'method', ['Dog.ok?'], 17, 17),
            ('method', 'function', ['top'], 20, 22),
        ],
    ),
    "php": (
        r'''<?php
function top($a) { return "}"; }
class C extends D {
    public static function make(): self { $x = <<<EOT
function no() {
EOT;
        return new self(); }
    # function no2() {}
}
''',
        [
            ('function_definition', 'function', ['top'], 2, 2),
            ('class_declaration', 'class', ['C'], 3, 9),
            ('method_declaration', 'method', ['C.make'], 4, 7),
        ],
    ),
}


@pytest.mark.parametrize("language", FILES)
def test_blocks_of_a_file(language):
    text, expected = FILES[language]
    found = blocks.scan(text, language)
    assert [(b[5], b[1], b[2], b[3], b[4]) for b in found] == expected
    lines = text.split("\n")
    assert all(b[0] == "\n".join(lines[b[3] - 1 : b[4]]) for b in found)
    assert set(FILES) == set(blocks.LANGUAGES)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(sorted(FILES)), st.integers(0, 10**6), st.integers(0, 10**6), st.sampled_from(["{", "}", "end", '"', "'", "/*", "(", "\n", "=>", "<<~A"]))
def test_broken_code_gives_blocks_or_none(language, a, b, put):
    text = FILES[language][0]
    a, b = sorted((a % len(text), b % len(text)))
    broken = text[:a] + put + text[b:]
    found = blocks.scan(broken, language)
    assert all(1 <= x[3] <= x[4] <= broken.count("\n") + 1 for x in found)
    assert chunking.code_blocks(broken, language)


def test_others_are_one_module():
    assert [b[1] for b in chunking.code_blocks("a b", "cobol")] == ["module"] and chunking.code_blocks("", "go") == [] == chunking.code_blocks(None, "go")
    assert [b[1] for b in chunking.code_blocks("function f() {" + "x" * 30_000 + "}", "javascript")] == ["module"]
