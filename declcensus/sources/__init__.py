"""Sources of source files: directory trees and tables."""
