"""Readers: source trees and external scanner reports."""
