"""Sources and sinks: file trees and stored catalogs."""
