SELECT conv_id * 100 + turn AS review_id, 'ch' || CAST(conv_id % 3 AS STRING) AS channel_id,
  TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 100 + turn * 2) * INTERVAL '1' MINUTE AS ts,
  CASE (conv_id + turn) % 8
  WHEN 0 THEN text || ' ' || text
  WHEN 1 THEN text
  WHEN 2 THEN 'In auth.js the login method should handle validation because ' || text
  WHEN 3 THEN '- Fix the cache in src/a.py, because the method Load must change to `pool`.' || chr(10)
    || '- Add a test for class Bar; use the `Pool` instead of src/b.go, therefore consider it.' || chr(10)
    || '1. Rename variable foo, in order to handle `x`; should replace with y rather than z.' || chr(10)
    || '2) Update function Baz since ```a``` is the current approach. TODO: move to c. FIXME: d' || chr(10) || chr(10)
    || 'Security, performance, testing, validation, documentation, dependency: ' || text
  WHEN 4 THEN text || chr(10) || chr(10) || 'Consider refactoring; security and performance. See src/a/b.py:10-20 and UserAuthentication.java, lines 45-52. Then ' || 'src/' || CASE (4 * conv_id) % 5 WHEN 1 THEN 'test_f30' WHEN 2 THEN 'AdminController54' WHEN 3 THEN 'f78' WHEN 4 THEN 'test_f102' ELSE 'f6' END || '.php' || ':2-4, ' || upper('src/' || CASE (4 * conv_id) % 5 WHEN 1 THEN 'test_f30' WHEN 2 THEN 'AdminController54' WHEN 3 THEN 'f78' WHEN 4 THEN 'test_f102' ELSE 'f6' END || '.php') || ':900-950, ' || 'src/' || CASE (4 * conv_id) % 5 WHEN 1 THEN 'test_f30' WHEN 2 THEN 'AdminController54' WHEN 3 THEN 'f78' WHEN 4 THEN 'test_f102' ELSE 'f6' END || '.php' || ':7-3 and ' || 'src/' || CASE (4 * conv_id) % 5 WHEN 1 THEN 'test_f30' WHEN 2 THEN 'AdminController54' WHEN 3 THEN 'f78' WHEN 4 THEN 'test_f102' ELSE 'f6' END || '.php' || ':0-2'
  WHEN 5 THEN 'TODO: change to x. ```java' || chr(10) || 'if (a) { }' || chr(10) || '``` this means an improvement, rather than the current approach: ' || text
  WHEN 6 THEN text || ' must be simplified. FIXME: error handling, edge case, testing, documentation, dependency, interface'
  WHEN 7 THEN '- Refactor src/a.py, because the method Load must change to `pool`; security, testing.' || chr(10)
    || '1. Use the `Pool` instead of class Bar, should replace with `y`. TODO: move to c' || chr(10) || text
  ELSE text END AS message
FROM conversations
UNION ALL
SELECT conv_id * 100 + turn + 50, 'ch' || CAST(conv_id % 3 AS STRING),
  TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 100 + turn * 2) * INTERVAL '1' MINUTE, ''
FROM conversations WHERE (conv_id + turn) % 8 = 0
