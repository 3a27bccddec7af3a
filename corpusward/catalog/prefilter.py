"""Cheap necessary conditions of the rules.

A rule can only match a file whose case-folded text holds certain words.
``NEEDS[label]`` lists them in conjunctive form: every group must have at least
one word present.  The test is a plain byte search, so most rules never start
their regular expression on most files.  A missing label means "no condition".
``tests/test_catalog.py`` checks that no condition loses a match.
"""

_API_KEY = ['apikey', 'api_key', 'api-key']
_TODO = ['todo', 'fixme', 'xxx', 'hack', 'bug', 'note', 'security', 'deprecated', 'warning']
_SUSPICIOUS = ['password', 'secret', 'key', 'token', 'admin', 'backdoor', 'debug', 'test', 'hardcoded']
_JQ = ['$(']
_QUERY = ['?', '&']

NEEDS = {
    # keys and credentials
    'AWS Access Key ID': [['akia']],
    'AWS Secret Key': [['aws'], ['secret']],
    'Google API Key': [['aiza', 'google']],
    'GitHub Personal Access Token': [['ghp_']],
    'GitHub Fine-grained Token': [['github_pat_']],
    'Stripe Live Secret Key': [['sk_live_']],
    'Stripe Test Secret Key': [['sk_test_']],
    'Stripe Live Publishable Key': [['pk_live_']],
    'Stripe Test Publishable Key': [['pk_test_']],
    'PayPal Access Token': [['access_token$production$']],
    'Slack Token': [['xox']],
    'Firebase Cloud Messaging Token': [['aaaa'], [':']],
    'SendGrid API Key': [['sg.']],
    'Mailgun API Key': [['key-']],
    'DigitalOcean Personal Access Token': [['dop_v1_']],
    'Square Access Token': [['sq0atp-']],
    'Square Client Secret': [['sq0csp-']],
    'JWT Token': [['eyj']],
    'Generic API Key': [_API_KEY],
    'Secret Key': [['secret']],
    'Generic API Key (no quotes)': [_API_KEY],
    'Generic Token': [['token', 'secret']],
    'Password': [['password', 'passwd', 'pwd']],
    'Database Password': [['password'], ['db', 'database']],
    'Username': [['username', 'user_name', 'user-name', 'login']],
    'Email Address': [['@']],
    # comments
    'Interesting Comment': [['//'], _TODO + ['temp']],
    'Interesting Comment (Multi-line)': [['/*'], ['*/'], _TODO],
    'Suspicious Comment': [['//'], _SUSPICIOUS],
    # sinks
    'innerHTML Assignment': [['.innerhtml']],
    'outerHTML Assignment': [['.outerhtml']],
    'document.body.innerHTML': [['document.body.innerhtml']],
    'insertAdjacentHTML': [['.insertadjacenthtml']],
    'document.write()': [['document.write']],
    'document.writeln()': [['document.writeln']],
    'eval() with User Input': [['eval']],
    'new Function() (eval)': [['new'], ['function']],
    'React dangerouslySetInnerHTML': [['dangerouslysetinnerhtml']],
    'jQuery .html()': [_JQ, [').html']],
    'jQuery .append()': [_JQ, [').append']],
    'jQuery .prepend()': [_JQ, [').prepend']],
    'jQuery .wrap()': [_JQ, [').wrap']],
    'jQuery .replaceWith()': [_JQ, [').replacewith']],
    'Location Manipulation': [['location.']],
    'location.assign()': [['location.assign']],
    'location.replace()': [['location.replace']],
    'innerHTML Concatenation': [['innerhtml']],
    'javascript: Protocol': [['javascript:']],
    'setTimeout with String (eval)': [['settimeout']],
    'setInterval with String (eval)': [['setinterval']],
    'Dangerous setAttribute': [['.setattribute']],
    'setAttribute(onclick)': [['.setattribute'], ['onclick']],
    'document.execCommand': [['document.execcommand']],
    'window.open with User Input': [['window.open']],
    'window.name Assignment': [['window.name']],
    'Cookie Manipulation': [['document.cookie']],
    'AngularJS $sce.trustAsHtml': [['$sce.trustashtml']],
    'AngularJS ng-bind-html': [['ng-bind-html']],
    'Vue v-html': [['v-html']],
    'Function with DOM Manipulation': [['function'], ['.innerhtml', '.outerhtml', '.write', '.insertadjacenthtml']],
    'Function with eval()': [['function'], ['eval']],
    'Arrow function with DOM manipulation': [['function'], ['.innerhtml', '.outerhtml', '.write']],
    'Event handler assignment': [['.on'], ['function']],
    'postMessage Listener (Check Origin!)': [['window.addeventlistener'], ['message']],
    # endpoints
    'fetch()': [['fetch']],
    'fetch() (template)': [['fetch'], ['`']],
    'XMLHttpRequest': [['.open']],
    'axios': [['axios.']],
    'axios (config)': [['axios'], ['url']],
    'jQuery AJAX': [['$.'], ['url']],
    'jQuery AJAX (short)': [['$.ajax', '$.get', '$.post']],
    'jQuery getJSON': [['$.getjson']],
    'API Path': [['/api/']],
    'API Versioned Path': [['/v']],
    'Base URL': [['baseurl']],
    'API URL Variable': [['apiurl', 'api_url', 'api-url']],
    # parameters
    'URL Query Parameter': [_QUERY, ['=']],
    'Query Parameter': [_QUERY, ['=']],
    'URL with Multiple Parameters': [['&'], ['=']],
    'URL with Query Parameters': [_QUERY],
    'URL Parameters Object': [['urlsearchparams']],
    'URLSearchParams Constructor': [['urlsearchparams']],
    'URLSearchParams.get()': [['.get']],
    'URLSearchParams.getAll()': [['.getall']],
    'URLSearchParams.has()': [['.has']],
    'Request Parameters': [['.get', '.post', '.put', '.delete', '.patch', '.head', '.options'], ['{']],
    'Request Parameters (short)': [['.get', '.post', '.put', '.delete', '.patch']],
    'Fetch Request Parameters': [['fetch'], ['{']],
    'Axios Request Parameters': [['axios'], ['{']],
    'URL Constructor with Parameters': [['new'], ['url']],
    'Location with Parameters': [['location.search', 'location.href'], _QUERY],
    'Window Location with Parameters': [['window.location.'], _QUERY],
    'Document Location with Parameters': [['document.location.'], _QUERY],
    'Template Literal with Parameters': [['`'], _QUERY],
    'Object Parameters': [['{'], ['}'], [':']],
    'Destructuring Parameters (const)': [['const'], ['{']],
    'Destructuring Parameters (let)': [['let'], ['{']],
    'Destructuring Parameters (var)': [['var'], ['{']],
    'Function with Destructuring': [['function'], ['({']],
    'Array Destructuring (const)': [['const'], ['[']],
    'Array Destructuring (let)': [['let'], ['[']],
    'Event Handler Parameters': [['.on'], ['function']],
    'EventListener Parameters': [['.addeventlistener'], ['function']],
    'EventListener Arrow Parameters': [['.addeventlistener'], ['=>']],
    # paths and scripts
    'Hardcoded URL': [['http://', 'https://']],
    'Relative Path': [['./']],
    'Path Variable': [['path']],
    'Directory Variable': [['dir']],
    'File Path': [['.js', '.json', '.html', '.css', '.png', '.jpg', '.svg']],
    'System Path (Linux)': [['/etc/']],
    'System Path (Windows)': [[':\\']],
    'System Path (Var)': [['/var/']],
    'Home Directory Path': [['/home/']],
    'Script Source': [['<script']],
    # banners, libraries, obfuscation
    'Server Header (X-Powered-By)': [['x-powered-by']],
    'Server Header (Server)': [['server']],
    'Apache Version': [['apache/']],
    'Nginx Version': [['nginx/']],
    'IIS Version': [['iis/']],
    'PHP Version': [['php/']],
    'Werkzeug Version': [['werkzeug/']],
    'jQuery Version': [['jquery']],
    'React Version': [['react']],
    'Vue.js Version': [['vue']],
    'AngularJS Version': [['angularjs']],
    'Bootstrap Version': [['bootstrap']],
    'Lodash Version': [['lodash']],
    'Moment.js Version': [['moment.js']],
    'Axios Version': [['axios']],
    'React Dependency': [['react']],
    'Vue Dependency': [['vue']],
    'jQuery Dependency': [['jquery']],
    'jQuery Global': [['window.jquery']],
    'React Global': [['window.react']],
    'Vue Global': [['window.vue']],
    'Source Map (v3)': [['//#'], ['sourcemappingurl=']],
    'Source Map (Legacy)': [['//@'], ['sourcemappingurl=']],
    'Packed/Obfuscated Code (Dean Edwards)': [['eval(function(p,a,c,k,e,d)']],
    'Obfuscated Variable (_0x...)': [['_0x']],
    'Hex Encoded Strings': [['\\x']],
}

# Necessary parts of rules without a telling word, as expressions on the folded
# text that start with a plain character (and so are found fast).
SHAPES = {
    'Twilio Account SID': r'ac[a-z0-9]{32}',
    'Twilio API Key': r'sk[a-z0-9]{32}',
    'Heroku API Key': r'-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-',
    'IPv4 Address': r'\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]',
    'IPv6 Address': r':[0-9a-f]{1,4}:[0-9a-f]{1,4}:',
}
