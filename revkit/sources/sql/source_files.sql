SELECT 'repo' || CAST((doc_id - doc_id % 24) % 5 AS STRING) AS repo,
  'src/' || CASE (doc_id - doc_id % 24) % 9 WHEN 3 THEN 'AdminController' WHEN 6 THEN 'test_f' ELSE 'f' END
    || CAST(CASE WHEN doc_id % 24 >= 12 AND doc_id % 12 IN (0, 9) THEN doc_id - 12 ELSE doc_id END AS STRING)
    || CASE WHEN doc_id % 24 >= 12 AND doc_id % 12 IN (0, 9) THEN '_test' ELSE '' END
    || CASE WHEN doc_id % 12 < 3 THEN '.py' WHEN doc_id % 12 < 6 THEN '.java' WHEN doc_id % 12 < 9 THEN '.php'
            WHEN doc_id % 12 < 11 THEN '.go' ELSE '.JS' END AS path,
  CASE doc_id % 12
  WHEN 0 THEN 'import os' || chr(10) || 'import requests' || chr(10) || 'import abc' || chr(10) || 'from os import *' || chr(10)
    || 'def load(a, b=[]):' || chr(10) || '    try:' || chr(10) || '        run(a + b)' || chr(10) || '    except:' || chr(10) || '        pass' || chr(10)
    || '# TODO ' || text || chr(10) || 'camelCase = 1' || chr(10) || '_X = f(2))' || chr(10)
  WHEN 1 THEN 'class Foo:' || chr(10) || '    """' || text || '"""' || chr(10) || '    def bar(self):' || chr(10)
    || chr(9) || '    password = ' || chr(39) || 'abcd' || chr(39) || chr(10) || '        for x in self.y:' || chr(10) || '            out += "' || text || '"' || chr(10)
    || '            l += [x]' || chr(10) || '        for z in l:' || chr(10) || '            l += [z]' || chr(10) || '        print "x"' || chr(10)
  WHEN 2 THEN 'def long(' || chr(10) || '        a,' || chr(10) || '        b):' || chr(10) || repeat('    tmp = a' || chr(10), CAST(40 + doc_id % 30 AS INT)) || 'import urllib2' || chr(10)
    || 'cursor.execute("select %s" % a)' || chr(10) || 'except Exception:' || chr(10) || text
  WHEN 3 THEN 'import java.util.*;' || chr(10) || 'public class A implements Serializable {' || chr(10) || chr(10) || '  public int size = ' || CAST(doc_id AS STRING) || ';' || chr(10)
    || '  // FIXME: ' || text || '  ' || chr(10) || '  void m() { try { x(); } catch (Throwable t) { } }' || chr(10) || '  void n() { System.out.print(3.14); }' || chr(10) || '}'
  WHEN 4 THEN 'class B { String a = "' || replace(text, chr(34), ' ') || '", b = "another long literal", c = "third long literal here", d = "fourth long literal";' || chr(13) || chr(10)
    || '  void p() { try { r = new FileInputStream(f); r.close(); }' || chr(10) || '  if (a && b && c || d) { } }' || chr(10) || 'try {' || chr(10) || '} catch (Exception e) {' || chr(10) || '}' || chr(10)
  WHEN 5 THEN repeat('import a.b.C;' || chr(10), 31) || repeat('if (x != null) { y(); }' || chr(10), 6) || 'public void big(int a) {' || chr(10) || repeat('  a >>= 1;' || chr(9) || chr(10), CAST(45 + doc_id % 12 AS INT)) || '}' || chr(10) || '// TODO ' || text || chr(10) || 'void t() { try { z(); } }' || chr(10)
  WHEN 6 THEN '<?php' || chr(10) || 'use Foo' || chr(92) || 'Bar;' || chr(10) || 'echo $_GET["q"];' || chr(10) || '$db->query("select " . $x);' || chr(10) || 'md5($p); @fopen($f); eval($c);' || chr(10) || text
  WHEN 7 THEN repeat('md5($a); sha1($b);' || chr(10), 3) || '<form action="/x" method="post">' || chr(10) || '$c = ["password" => "abcdef", "key" => "' || replace(text, chr(34), ' ') || '"];' || chr(10) || 'header("Location: $u"); exit(); session_start(); $_FILES["a"];' || chr(10)
  WHEN 8 THEN '<?php ?> x <?php' || chr(10) || 'const abc = 1; global $g; var_dump($g); if ($a === null) { die(1); }' || chr(10) || 'include ($p); system($cmd); split("a"); mysql_query($q);' || chr(10) || text
  WHEN 9 THEN 'package x' || chr(10) || 'import (' || chr(10) || '  "context"' || chr(10) || '  _ "fmt"' || chr(10) || ')' || chr(10) || 'func Load(a int) (n int, err error) {' || chr(10) || '  if err := f(); err != nil {' || chr(10) || '    log(err)' || chr(10) || '  }' || chr(10) || '  return' || chr(10) || '}' || chr(10) || '// TODO: ' || text
  WHEN 10 THEN '// Package y docs' || chr(10) || '// ' || text || chr(10) || 'package y' || chr(10) || 'func run() error {' || chr(10) || '  ' || CASE WHEN doc_id % 24 >= 12 THEN 'var v, err = ' ELSE 'v, err := ' END || 'ioutil.ReadAll(r)' || chr(10) || '  if err != nil {' || chr(10) || '    return err' || chr(10) || '  }' || chr(10) || '  return nil' || chr(10) || '}' || chr(10) || chr(10)
    || '// TODO: bad' || chr(10) || 'func Bad(x interface{}) (n int, err error) {' || chr(10) || '  var wg sync.WaitGroup' || chr(10)
    || repeat('  if err != nil {' || chr(10) || '    log(err) // FIXME: panic(err)' || chr(10) || '  }' || chr(10), 4) || '  if x == nil { panic(x) } // TODO: y' || chr(10)
    || repeat('  n = 1' || chr(10), CAST(30 + doc_id % 40 AS INT)) || '  return' || chr(10) || '}' || chr(10)
    || 'func Many[T any](' || chr(10) || '  a T,' || chr(10) || '  b int,' || chr(10) || ') T {' || chr(10) || '  return a' || chr(10) || '}' || chr(10) || repeat(chr(10), CAST(doc_id % 36 * 10 AS INT))
  ELSE 'const a = 1; // ' || text || chr(10) || 'if (a && b && c && d) { console.log(a) }' END AS content
FROM documents
