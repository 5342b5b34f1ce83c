"""The full rule catalogue as data: (kind, languages, framework, pattern, tag, severity, power, classes).

Fixed values, in order of precedence within a language and kind.
"""

CATALOGUE = [
    ("source", "python", None, "request.get", "http_param", None, None, None),
    ("source", "python", None, "request.args.get", "http_param", None, None, None),
    ("source", "python", None, "request.form.get", "http_param", None, None, None),
    ("source", "python", None, "request.form", "http_param", None, None, None),
    ("source", "python", None, "request.args", "http_param", None, None, None),
    ("source", "python", None, "request.json", "http_body", None, None, None),
    ("source", "python", None, "request.data", "http_body", None, None, None),
    ("source", "python", None, "request.cookies.get", "http_cookie", None, None, None),
    ("source", "python", None, "request.headers.get", "http_header", None, None, None),
    ("source", "python", None, "request.values.get", "http_param", None, None, None),
    ("source", "python", None, "request.query_params.get", "http_param", None, None, None),
    ("source", "python", None, "request.query_params", "http_param", None, None, None),
    ("source", "python", None, "sys.argv", "cli_arg", None, None, None),
    ("source", "python", None, "input(", "user_input", None, None, None),
    ("source", "python", None, "os.environ.get", "env_var", None, None, None),
    ("source", "python", None, "Query(", "http_param", None, None, None),
    ("source", "python", None, "Path(", "http_param", None, None, None),
    ("source", "python", None, "Body(", "http_body", None, None, None),
    ("source", "python", None, "Header(", "http_header", None, None, None),
    ("source", "python", None, "request.files", "http_upload", None, None, None),
    ("sink", "python", None, "cursor.execute", "sqli", "critical", None, None),
    ("sink", "python", None, "cursor.executemany", "sqli", "critical", None, None),
    ("sink", "python", None, "db.execute", "sqli", "critical", None, None),
    ("sink", "python", None, "engine.execute", "sqli", "critical", None, None),
    ("sink", "python", None, "session.execute", "sqli", "critical", None, None),
    ("sink", "python", None, ".raw(", "sqli", "high", None, None),
    ("sink", "python", None, ".extra(", "sqli", "high", None, None),
    ("sink", "python", None, "os.system(", "cmdi", "critical", None, None),
    ("sink", "python", None, "os.popen(", "cmdi", "critical", None, None),
    ("sink", "python", None, "subprocess.call(", "cmdi", "critical", None, None),
    ("sink", "python", None, "subprocess.run(", "cmdi", "critical", None, None),
    ("sink", "python", None, "subprocess.Popen(", "cmdi", "critical", None, None),
    ("sink", "python", None, "subprocess.check_output(", "cmdi", "critical", None, None),
    ("sink", "python", None, "eval(", "cmdi", "critical", None, None),
    ("sink", "python", None, "exec(", "cmdi", "critical", None, None),
    ("sink", "python", None, "open(", "path_traversal", "high", None, None),
    ("sink", "python", None, "send_file(", "path_traversal", "high", None, None),
    ("sink", "python", None, "send_from_directory(", "path_traversal", "high", None, None),
    ("sink", "python", None, "shutil.copy(", "path_traversal", "high", None, None),
    ("sink", "python", None, "os.remove(", "path_traversal", "high", None, None),
    ("sink", "python", None, "os.rename(", "path_traversal", "high", None, None),
    ("sink", "python", None, "render_template_string(", "ssti", "critical", None, None),
    ("sink", "python", None, "jinja2.Template(", "ssti", "critical", None, None),
    ("sink", "python", None, "Template(", "ssti", "critical", None, None),
    ("sink", "python", None, "requests.get(", "ssrf", "critical", None, None),
    ("sink", "python", None, "requests.post(", "ssrf", "critical", None, None),
    ("sink", "python", None, "requests.put(", "ssrf", "critical", None, None),
    ("sink", "python", None, "requests.request(", "ssrf", "critical", None, None),
    ("sink", "python", None, "urllib.request.urlopen(", "ssrf", "critical", None, None),
    ("sink", "python", None, "httpx.get(", "ssrf", "critical", None, None),
    ("sink", "python", None, "httpx.post(", "ssrf", "critical", None, None),
    ("sink", "python", None, "session.get(", "ssrf", "high", None, None),
    ("sink", "python", None, "session.post(", "ssrf", "high", None, None),
    ("sink", "python", None, "pickle.loads(", "deserialization", "critical", None, None),
    ("sink", "python", None, "pickle.load(", "deserialization", "critical", None, None),
    ("sink", "python", None, "yaml.load(", "deserialization", "critical", None, None),
    ("sink", "python", None, "yaml.unsafe_load(", "deserialization", "critical", None, None),
    ("sink", "python", None, "marshal.loads(", "deserialization", "critical", None, None),
    ("sink", "python", None, "shelve.open(", "deserialization", "high", None, None),
    ("sink", "python", None, "Markup(", "xss", "high", None, None),
    ("sink", "python", None, "render_template_string(", "xss", "high", None, None),
    ("sanitizer", "python", None, "?\", (", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "?', (", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "?\", [", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "%s\", (", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "%s', (", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "execute(%s,", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "execute(%s,", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, ".filter(", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, ".filter_by(", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "shlex.quote(", None, None, 0.9, ["cmdi"]),
    ("sanitizer", "python", None, "shlex.split(", None, None, 0.75, ["cmdi"]),
    ("sanitizer", "python", None, "os.path.realpath(", None, None, 0.5, ["path_traversal"]),
    ("sanitizer", "python", None, "os.path.abspath(", None, None, 0.4, ["path_traversal"]),
    ("sanitizer", "python", None, "html.escape(", None, None, 0.9, ["xss"]),
    ("sanitizer", "python", None, "markupsafe.escape(", None, None, 0.9, ["xss"]),
    ("sanitizer", "python", None, "escape(", None, None, 0.9, ["xss"]),
    ("sanitizer", "python", None, "bleach.clean(", None, None, 0.85, ["xss"]),
    ("sanitizer", "python", None, "DOMPurify.sanitize(", None, None, 0.9, ["xss"]),
    ("sanitizer", "python", None, "yaml.safe_load(", None, None, 0.95, ["deserialization"]),
    ("sanitizer", "python", None, "SafeLoader", None, None, 0.95, ["deserialization"]),
    ("sanitizer", "python", None, "urlparse(", None, None, 0.3, ["ssrf", "open_redirect"]),
    ("sanitizer", "python", None, ".hostname", None, None, 0.2, ["ssrf"]),
    ("sanitizer", "python", None, "urllib.parse.quote(", None, None, 0.1, ["ssrf"]),
    ("sanitizer", "python", None, "SandboxedEnvironment", None, None, 0.95, ["ssti"]),
    ("sanitizer", "python", None, "re.match(", None, None, 0.7, ["sqli", "cmdi", "path_traversal"]),
    ("sanitizer", "python", None, "re.sub(", None, None, 0.5, ["sqli", "cmdi", "log_injection"]),
    ("sanitizer", "python", None, ".replace(", None, None, 0.15, ["sqli", "log_injection"]),
    ("sanitizer", "python", None, ".strip(", None, None, 0.05, ["log_injection"]),
    ("sanitizer", "python", None, "int(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "ssti", "xss"]),
    ("sanitizer", "python", None, "float(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "ssti", "xss"]),
    ("source", "javascript", None, "req.params", "http_param", None, None, None),
    ("source", "javascript", None, "req.query", "http_param", None, None, None),
    ("source", "javascript", None, "req.body", "http_body", None, None, None),
    ("source", "javascript", None, "req.headers", "http_header", None, None, None),
    ("source", "javascript", None, "req.cookies", "http_cookie", None, None, None),
    ("source", "javascript", None, "process.argv", "cli_arg", None, None, None),
    ("source", "javascript", None, "process.env", "env_var", None, None, None),
    ("source", "javascript", None, "readline.question", "user_input", None, None, None),
    ("source", "javascript", None, "prompt(", "user_input", None, None, None),
    ("sink", "javascript", None, "db.query(", "sqli", "critical", None, None),
    ("sink", "javascript", None, "connection.query(", "sqli", "critical", None, None),
    ("sink", "javascript", None, "pool.query(", "sqli", "critical", None, None),
    ("sink", "javascript", None, "sequelize.query(", "sqli", "critical", None, None),
    ("sink", "javascript", None, "knex.raw(", "sqli", "critical", None, None),
    ("sink", "javascript", None, ".query(`", "sqli", "critical", None, None),
    ("sink", "javascript", None, ".query(`SELECT", "sqli", "critical", None, None),
    ("sink", "javascript", None, "child_process.exec(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "exec(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "execSync(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "child_process.spawn(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "eval(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "new Function(", "cmdi", "critical", None, None),
    ("sink", "javascript", None, "setTimeout(", "cmdi", "high", None, None),
    ("sink", "javascript", None, "setInterval(", "cmdi", "high", None, None),
    ("sink", "javascript", None, "fs.readFile(", "path_traversal", "high", None, None),
    ("sink", "javascript", None, "fs.readFileSync(", "path_traversal", "high", None, None),
    ("sink", "javascript", None, "fs.createReadStream(", "path_traversal", "high", None, None),
    ("sink", "javascript", None, "res.sendFile(", "path_traversal", "high", None, None),
    ("sink", "javascript", None, "ejs.render(", "ssti", "high", None, None),
    ("sink", "javascript", None, "pug.render(", "ssti", "high", None, None),
    ("sink", "javascript", None, "Handlebars.compile(", "ssti", "high", None, None),
    ("sink", "javascript", None, "fetch(", "ssrf", "high", None, None),
    ("sink", "javascript", None, "axios.get(", "ssrf", "high", None, None),
    ("sink", "javascript", None, "axios.post(", "ssrf", "high", None, None),
    ("sink", "javascript", None, "http.request(", "ssrf", "high", None, None),
    ("sink", "javascript", None, "res.send(", "xss", "high", None, None),
    ("sink", "javascript", None, "res.write(", "xss", "high", None, None),
    ("sink", "javascript", None, "innerHTML", "xss", "high", None, None),
    ("sink", "javascript", None, "document.write(", "xss", "critical", None, None),
    ("sink", "javascript", None, "unserialize(", "deserialization", "critical", None, None),
    ("sink", "javascript", None, "js-yaml.load(", "deserialization", "high", None, None),
    ("sanitizer", "javascript", None, "query('", None, None, 0.99, ["sqli"]),
    ("sanitizer", "javascript", None, "query(\"", None, None, 0.99, ["sqli"]),
    ("sanitizer", "javascript", None, "?, [", None, None, 0.9, ["sqli"]),
    ("sanitizer", "javascript", None, "db.query(\"", None, None, 0.99, ["sqli"]),
    ("sanitizer", "javascript", None, ".where(", None, None, 0.95, ["sqli"]),
    ("sanitizer", "javascript", None, "execFile(", None, None, 0.9, ["cmdi", "xss"]),
    ("sanitizer", "javascript", None, "shell-escape", None, None, 0.9, ["cmdi"]),
    ("sanitizer", "javascript", None, "shellEscape(", None, None, 0.9, ["cmdi"]),
    ("sanitizer", "javascript", None, "DOMPurify.sanitize(", None, None, 0.9, ["xss"]),
    ("sanitizer", "javascript", None, "escape-html", None, None, 0.9, ["xss"]),
    ("sanitizer", "javascript", None, "he.encode(", None, None, 0.9, ["xss"]),
    ("sanitizer", "javascript", None, "escapeHtml(", None, None, 0.9, ["xss"]),
    ("sanitizer", "javascript", None, "path.resolve(", None, None, 0.45, ["path_traversal"]),
    ("sanitizer", "javascript", None, ".startsWith(", None, None, 0.4, ["path_traversal"]),
    ("sanitizer", "javascript", None, "new URL(", None, None, 0.3, ["ssrf"]),
    ("sanitizer", "javascript", None, ".hostname", None, None, 0.2, ["ssrf"]),
    ("sanitizer", "javascript", None, "parseInt(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "ssti", "xss"]),
    ("sanitizer", "javascript", None, "parseFloat(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "ssti", "xss"]),
    ("sanitizer", "javascript", None, "Number(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "ssti", "xss"]),
    ("source", "java", None, "request.getParameter(", "http_param", None, None, None),
    ("source", "java", None, "request.getParameterValues(", "http_param", None, None, None),
    ("source", "java", None, "getParameter(", "http_param", None, None, None),
    ("source", "java", None, "request.getHeader(", "http_header", None, None, None),
    ("source", "java", None, "request.getQueryString(", "http_param", None, None, None),
    ("source", "java", None, "request.getCookies(", "http_cookie", None, None, None),
    ("source", "java", None, "getInputStream(", "http_body", None, None, None),
    ("source", "java", None, "@RequestParam", "http_param", None, None, None),
    ("source", "java", None, "@PathVariable", "http_param", None, None, None),
    ("source", "java", None, "@RequestBody", "http_body", None, None, None),
    ("source", "java", None, "@RequestHeader", "http_header", None, None, None),
    ("source", "java", None, "System.getenv(", "env_var", None, None, None),
    ("sink", "java", None, "executeQuery(", "sqli", "critical", None, None),
    ("sink", "java", None, "executeUpdate(", "sqli", "critical", None, None),
    ("sink", "java", None, "executeLargeUpdate(", "sqli", "critical", None, None),
    ("sink", "java", None, "createQuery(", "sqli", "high", None, None),
    ("sink", "java", None, "createNativeQuery(", "sqli", "high", None, None),
    ("sink", "java", None, ".exec(", "cmdi", "critical", None, None),
    ("sink", "java", None, "getRuntime().exec(", "cmdi", "critical", None, None),
    ("sink", "java", None, "ProcessBuilder(", "cmdi", "critical", None, None),
    ("sink", "java", None, "new File(", "path_traversal", "high", None, None),
    ("sink", "java", None, "new FileInputStream(", "path_traversal", "high", None, None),
    ("sink", "java", None, "new FileReader(", "path_traversal", "high", None, None),
    ("sink", "java", None, "new FileOutputStream(", "path_traversal", "high", None, None),
    ("sink", "java", None, "Files.readAllBytes(", "path_traversal", "high", None, None),
    ("sink", "java", None, "Files.newInputStream(", "path_traversal", "high", None, None),
    ("sink", "java", None, "Files.lines(", "path_traversal", "high", None, None),
    ("sink", "java", None, "getWriter().print", "xss", "high", None, None),
    ("sink", "java", None, "getWriter().write", "xss", "high", None, None),
    ("sink", "java", None, ".openConnection(", "ssrf", "high", None, None),
    ("sink", "java", None, ".openStream(", "ssrf", "high", None, None),
    ("sink", "java", None, "readObject(", "deserialization", "critical", None, None),
    ("sink", "java", None, "new ObjectInputStream(", "deserialization", "high", None, None),
    ("sanitizer", "java", None, "Integer.parseInt(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "java", None, "Long.parseLong(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "java", None, "Double.parseDouble(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "java", None, "prepareStatement(", None, None, 0.9, ["sqli"]),
    ("sanitizer", "java", None, "setString(", None, None, 0.85, ["sqli"]),
    ("sanitizer", "java", None, "FilenameUtils.getName(", None, None, 0.9, ["path_traversal"]),
    ("sanitizer", "java", None, ".getCanonicalPath(", None, None, 0.55, ["path_traversal"]),
    ("sanitizer", "java", None, ".normalize(", None, None, 0.45, ["path_traversal"]),
    ("sanitizer", "java", None, "encodeForHTML(", None, None, 0.9, ["xss"]),
    ("sanitizer", "java", None, "StringEscapeUtils.escapeHtml", None, None, 0.9, ["xss"]),
    ("sanitizer", "java", None, "HtmlUtils.htmlEscape(", None, None, 0.9, ["xss"]),
    ("source", "go", None, "FormValue(", "http_param", None, None, None),
    ("source", "go", None, ".Query().Get(", "http_param", None, None, None),
    ("source", "go", None, "Header.Get(", "http_header", None, None, None),
    ("source", "go", None, "mux.Vars(", "http_param", None, None, None),
    ("source", "go", None, "c.Query(", "http_param", None, None, None),
    ("source", "go", None, "c.Param(", "http_param", None, None, None),
    ("source", "go", None, "c.PostForm(", "http_param", None, None, None),
    ("source", "go", None, "os.Getenv(", "env_var", None, None, None),
    ("sink", "go", None, "db.Query(", "sqli", "critical", None, None),
    ("sink", "go", None, "db.Exec(", "sqli", "critical", None, None),
    ("sink", "go", None, ".QueryRow(", "sqli", "high", None, None),
    ("sink", "go", None, "exec.Command(", "cmdi", "critical", None, None),
    ("sink", "go", None, "os.Open(", "path_traversal", "high", None, None),
    ("sink", "go", None, "os.ReadFile(", "path_traversal", "high", None, None),
    ("sink", "go", None, "ioutil.ReadFile(", "path_traversal", "high", None, None),
    ("sink", "go", None, "http.Get(", "ssrf", "high", None, None),
    ("sink", "go", None, "http.NewRequest(", "ssrf", "high", None, None),
    ("sanitizer", "go", None, "strconv.Atoi(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "go", None, "strconv.ParseInt(", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "go", None, "filepath.Base(", None, None, 0.9, ["path_traversal"]),
    ("sanitizer", "go", None, "template.HTMLEscapeString(", None, None, 0.9, ["xss"]),
    ("source", "ruby", None, "params[", "http_param", None, None, None),
    ("source", "ruby", None, "params.require(", "http_param", None, None, None),
    ("source", "ruby", None, "cookies[", "http_cookie", None, None, None),
    ("source", "ruby", None, "request.headers[", "http_header", None, None, None),
    ("source", "ruby", None, "ENV[", "env_var", None, None, None),
    ("sink", "ruby", None, "connection.execute(", "sqli", "critical", None, None),
    ("sink", "ruby", None, "find_by_sql(", "sqli", "critical", None, None),
    ("sink", "ruby", None, "system(", "cmdi", "critical", None, None),
    ("sink", "ruby", None, "IO.popen(", "cmdi", "critical", None, None),
    ("sink", "ruby", None, "File.open(", "path_traversal", "high", None, None),
    ("sink", "ruby", None, "File.read(", "path_traversal", "high", None, None),
    ("sink", "ruby", None, "send_file(", "path_traversal", "high", None, None),
    ("sink", "ruby", None, "Net::HTTP.get(", "ssrf", "high", None, None),
    ("sanitizer", "ruby", None, ".to_i", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "ruby", None, "Integer(", None, None, 0.9, ["sqli", "cmdi", "path_traversal", "ssrf", "xss"]),
    ("sanitizer", "ruby", None, "ERB::Util.html_escape(", None, None, 0.9, ["xss"]),
    ("sanitizer", "ruby", None, "File.basename(", None, None, 0.9, ["path_traversal"]),
    ("source", "c", None, "getenv(", "env_var", None, None, None),
    ("source", "c", None, "scanf(", "user_input", None, None, None),
    ("source", "c", None, "fgets(", "user_input", None, None, None),
    ("source", "c", None, "gets(", "user_input", None, None, None),
    ("source", "c", None, "recv(", "http_body", None, None, None),
    ("source", "c", None, "req.get(", "http_param", None, None, None),
    ("sink", "c", None, "system(", "cmdi", "critical", None, None),
    ("sink", "c", None, "popen(", "cmdi", "critical", None, None),
    ("sink", "c", None, "execlp(", "cmdi", "critical", None, None),
    ("sink", "c", None, "execvp(", "cmdi", "critical", None, None),
    ("sink", "c", None, "strcpy(", "buffer_overflow", "high", None, None),
    ("sink", "c", None, "strcat(", "buffer_overflow", "high", None, None),
    ("sink", "c", None, "sprintf(", "buffer_overflow", "high", None, None),
    ("sink", "c", None, "gets(", "buffer_overflow", "critical", None, None),
    ("sink", "c", None, "memcpy(", "buffer_overflow", "medium", None, None),
    ("sink", "c", None, "fopen(", "path_traversal", "high", None, None),
    ("sink", "c", None, "mysql_query(", "sqli", "critical", None, None),
    ("sink", "c", None, "PQexec(", "sqli", "critical", None, None),
    ("sink", "c", None, "sqlite3_exec(", "sqli", "critical", None, None),
    ("sink", "c", None, "->query(", "sqli", "high", None, None),
    ("sanitizer", "c", None, "atoi(", None, None, 0.9, ["sqli", "cmdi", "path_traversal", "buffer_overflow"]),
    ("sanitizer", "c", None, "strtol(", None, None, 0.9, ["sqli", "cmdi", "path_traversal", "buffer_overflow"]),
    ("sanitizer", "c", None, "snprintf(", None, None, 0.75, ["buffer_overflow"]),
    ("sanitizer", "c", None, "strncpy(", None, None, 0.6, ["buffer_overflow"]),
    ("source", "rust", None, ".param(", "http_param", None, None, None),
    ("source", "rust", None, "req.query(", "http_param", None, None, None),
    ("source", "rust", None, "std::env::var(", "env_var", None, None, None),
    ("source", "rust", None, "env::var(", "env_var", None, None, None),
    ("sink", "rust", None, "Command::new(", "cmdi", "critical", None, None),
    ("sink", "rust", None, "sqlx::query(", "sqli", "high", None, None),
    ("sink", "rust", None, "diesel::sql_query(", "sqli", "high", None, None),
    ("sink", "rust", None, "File::open(", "path_traversal", "high", None, None),
    ("sink", "rust", None, "fs::read(", "path_traversal", "high", None, None),
    ("sink", "rust", None, "fs::read_to_string(", "path_traversal", "high", None, None),
    ("sink", "rust", None, "reqwest::get(", "ssrf", "high", None, None),
    ("sanitizer", "rust", None, "parse::<", None, None, 0.95, ["sqli", "cmdi", "path_traversal", "ssrf"]),
    ("source", "bash", None, "$1", "cli_arg", None, None, None),
    ("source", "bash", None, "$2", "cli_arg", None, None, None),
    ("source", "bash", None, "$QUERY_STRING", "http_param", None, None, None),
    ("source", "bash", None, "read ", "user_input", None, None, None),
    ("sink", "bash", None, "eval ", "cmdi", "critical", None, None),
    ("sink", "bash", None, "bash -c", "cmdi", "critical", None, None),
    ("sink", "bash", None, "sh -c", "cmdi", "critical", None, None),
    ("sanitizer", "bash", None, "declare -i", None, None, 0.85, ["cmdi"]),
    ("sink", "python javascript", None, "redirect(", "open_redirect", "medium", None, None),
    ("sink", "python javascript", None, "return redirect(", "open_redirect", "medium", None, None),
    ("sink", "python javascript", None, "headers={\"Location\"", "open_redirect", "medium", None, None),
    ("sink", "python javascript", None, "res.redirect(", "open_redirect", "medium", None, None),
    ("sink", "python javascript", None, "logging.info(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logging.warning(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logging.error(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logging.debug(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logger.info(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logger.warning(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "logger.error(", "log_injection", "low", None, None),
    ("sink", "python javascript", None, "print(", "log_injection", "info", None, None),
    ("sink", "python javascript", None, "ldap.search_s(", "ldap_injection", "high", None, None),
    ("sink", "python javascript", None, ".search_s(", "ldap_injection", "high", None, None),
    ("sink", "python javascript", None, "ldap.search(", "ldap_injection", "high", None, None),
    ("sink", "python javascript", None, "ldap3.Connection.search(", "ldap_injection", "high", None, None),
    ("sink", "python javascript", None, ".search(", "ldap_injection", "medium", None, None),
    ("sink", "python javascript", None, "ET.parse(", "xxe", "high", None, None),
    ("sink", "python javascript", None, "ElementTree.parse(", "xxe", "high", None, None),
    ("sink", "python javascript", None, "etree.parse(", "xxe", "high", None, None),
    ("sink", "python javascript", None, "minidom.parse(", "xxe", "high", None, None),
    ("sink", "python javascript", None, "xml.sax.parse(", "xxe", "high", None, None),
    ("sink", "python javascript", None, "parseString(", "xxe", "high", None, None),
    ("sanitizer", "python javascript", None, ".startswith('/')", None, None, 0.85, ["open_redirect"]),
    ("sanitizer", "python javascript", None, ".startswith(\"/\")", None, None, 0.85, ["open_redirect"]),
    ("sanitizer", "python javascript", None, "urlparse(", None, None, 0.3, ["open_redirect"]),
    ("sanitizer", "python javascript", None, ".replace(\"\\n\", \"\").replace(\"\\r\", \"\")", None, None, 0.85, ["log_injection"]),
    ("sanitizer", "python javascript", None, ".replace('\\n', '').replace('\\r', '')", None, None, 0.85, ["log_injection"]),
    ("sanitizer", "python javascript", None, "re.sub(r'[\\r\\n]'", None, None, 0.85, ["log_injection"]),
    ("sanitizer", "python javascript", None, "escape_filter_chars(", None, None, 0.9, ["ldap_injection"]),
    ("sanitizer", "python javascript", None, "ldap.filter.escape_filter_chars(", None, None, 0.9, ["ldap_injection"]),
    ("sanitizer", "python javascript", None, "defusedxml.", None, None, 0.95, ["xxe"]),
    ("sanitizer", "python javascript", None, "resolve_entities=False", None, None, 0.9, ["xxe"]),
    ("sanitizer", "python javascript", None, "XMLParser(resolve_entities=False", None, None, 0.95, ["xxe"]),
    ("source", "*", "flask", "request.form.get(", "http_param", None, None, None),
    ("source", "*", "flask", "request.values.get(", "http_param", None, None, None),
    ("source", "*", "flask", "request.files.get(", "http_param", None, None, None),
    ("source", "*", "flask", "session.get(", "http_param", None, None, None),
    ("source", "*", "flask", "request.cookies.get(", "http_param", None, None, None),
    ("source", "*", "flask", "request.headers.get(", "http_param", None, None, None),
    ("source", "*", "flask", "request.data", "http_param", None, None, None),
    ("source", "*", "flask", "request.json", "http_param", None, None, None),
    ("sink", "*", "flask", "render_template_string(", "ssti", "high", None, None),
    ("sink", "*", "flask", "make_response(", "xss", "medium", None, None),
    ("sink", "*", "flask", "redirect(", "ssrf", "medium", None, None),
    ("sanitizer", "*", "flask", "render_template(", None, None, 0.0, ["xss"]),
    ("source", "*", "django", "request.GET.get(", "http_param", None, None, None),
    ("source", "*", "django", "request.POST.get(", "http_param", None, None, None),
    ("source", "*", "django", "request.FILES.get(", "http_param", None, None, None),
    ("source", "*", "django", "request.META.get(", "http_param", None, None, None),
    ("source", "*", "django", "request.data.get(", "http_param", None, None, None),
    ("source", "*", "django", "kwargs.get(", "http_param", None, None, None),
    ("source", "*", "django", "self.kwargs.get(", "http_param", None, None, None),
    ("sink", "*", "django", "mark_safe(", "xss", "high", None, None),
    ("sink", "*", "django", "format_html(", "xss", "medium", None, None),
    ("sink", "*", "django", ".raw(", "sqli", "high", None, None),
    ("sink", "*", "django", ".extra(", "sqli", "high", None, None),
    ("sanitizer", "*", "django", ".filter(", None, None, 0.0, ["sqli"]),
    ("sanitizer", "*", "django", ".get(", None, None, 0.0, ["sqli"]),
    ("sanitizer", "*", "django", ".exclude(", None, None, 0.0, ["sqli"]),
    ("sanitizer", "*", "django", "escape(", None, None, 0.0, ["xss"]),
    ("sanitizer", "*", "django", "conditional_escape(", None, None, 0.0, ["xss"]),
    ("source", "*", "fastapi", "Request.query_params.get(", "http_param", None, None, None),
    ("source", "*", "fastapi", "request.query_params.get(", "http_param", None, None, None),
    ("source", "*", "fastapi", "request.form()", "http_param", None, None, None),
    ("source", "*", "fastapi", "request.body()", "http_param", None, None, None),
    ("source", "*", "fastapi", "request.headers.get(", "http_param", None, None, None),
    ("source", "*", "fastapi", "request.cookies.get(", "http_param", None, None, None),
    ("sink", "*", "fastapi", "HTMLResponse(", "xss", "medium", None, None),
    ("sanitizer", "*", "fastapi", "JSONResponse(", None, None, 0.0, ["xss"]),
    ("source", "*", "express", "req.query.", "http_param", None, None, None),
    ("source", "*", "express", "req.body.", "http_param", None, None, None),
    ("source", "*", "express", "req.params.", "http_param", None, None, None),
    ("source", "*", "express", "req.headers[", "http_param", None, None, None),
    ("source", "*", "express", "req.cookies.", "http_param", None, None, None),
    ("source", "*", "express", "req.query[", "http_param", None, None, None),
    ("sink", "*", "express", "res.send(", "xss", "medium", None, None),
    ("sink", "*", "express", "res.render(", "ssti", "high", None, None),
    ("sink", "*", "express", "res.end(", "xss", "medium", None, None),
    ("sanitizer", "*", "express", "res.json(", None, None, 0.0, ["xss"]),
]

#: Rules beside the catalogue, which change verdicts: they count only where they are asked for, and come last.
MORE_RULES = [
    ("source", "python", None, "request.args.get(", "http_param", None, None, None),
    ("source", "python", None, "request.form.get(", "http_form", None, None, None),
    ("source", "python", None, "request.headers.get(", "http_header", None, None, None),
    ("source", "python", None, "os.environ", "environment", None, None, None),
    ("source", "go", None, "r.URL.Query()", "http_param", None, None, None),
    ("source", "go", None, "r.FormValue(", "http_form", None, None, None),
    ("source", "c", None, "argv[", "argument", None, None, None),
    ("source", "rust", None, "env::args(", "argument", None, None, None),
    ("sink", "python", None, "cursor.execute(", "sqli", "critical", None, None),
    ("sink", "python", None, "db.execute(", "sqli", "critical", None, None),
    ("sink", "javascript", None, ".innerHTML", "xss", "high", None, None),
    ("sanitizer", "python", None, "%s\",", None, None, 0.99, ["sqli"]),
    ("sanitizer", "python", None, "os.path.basename(", None, None, 0.7, ["path_traversal"]),
    ("sanitizer", "javascript", None, "encodeURIComponent(", None, None, 0.8, ["xss", "open_redirect"]),
    ("source", "*", "flask", "request.files", "http_file", None, None, None),
    ("sink", "*", "flask", "send_file(", "path_traversal", "high", None, None),
    ("sanitizer", "*", "flask", "escape(", None, None, 0.0, ["xss"]),
    ("source", "*", "django", "request.GET", "http_param", None, None, None),
]
